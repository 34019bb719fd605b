"""Parameter search and training data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators import metrics
from rankloom.operators.index import Index, numbered, numbered_within
from rankloom.operators.ranking import check, scored, small, top_k
from rankloom.sources.folders import stored

K1, B = (0.6, 0.9, 1.2, 1.5, 1.8), (0.2, 0.4, 0.6, 0.75, 0.9)


def draw(*parts: Column, seed: int = 42) -> Column:
    """A seeded draw per row, the same on any engine: rows sorted by it are in random order."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *parts))


#: Settings that the best cell is compared with on held-out queries.
KNOWN_SETTINGS = {"default": (0.9, 0.4), "textbook": (1.2, 0.75)}


def bm25_grid(queries: DataFrame, ix: Index, qrels: DataFrame, cells: list[tuple[float, float]] | None = None, depth: int = 5) -> DataFrame:
    """k1, b, query_id, ndcg_at_5 for every cell and judged query, in one job.

    The postings are brought together and read once, for all cells; `depth` rows of each cell and query leave a task.
    """
    cells = cells or [(float(a), float(b)) for a in K1 for b in B]
    for a, b in cells:
        check(a, b)
    settings = queries.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(cells)], "setting int, k1 double, b double")
    found = scored(queries.join(qrels.select("query_id").distinct(), "query_id", "left_semi"), ix, cells, depth)
    run = top_k(found, depth, ("setting", "query_id")).join(F.broadcast(settings), "setting").select("k1", "b", "query_id", "doc_id", "rank")
    run = run.join(qrels.select("query_id", "doc_id", "grade"), ["query_id", "doc_id"]).where("grade > 0")
    got = run.groupBy("k1", "b", "query_id").agg(F.sum(F.col("grade") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    best = metrics.dcg(metrics.ideal(qrels), depth, name="best")
    tried = F.explode(F.array(*[F.struct(F.lit(float(a)).alias("k1"), F.lit(float(b)).alias("b")) for a, b in cells]))
    judged = qrels.select("query_id").distinct().join(queries.select("query_id"), "query_id", "left_semi").select("query_id", tried.alias("c")).select("c.k1", "c.b", "query_id")
    both = judged.join(got, ["k1", "b", "query_id"], "left").join(best, "query_id", "left")
    return both.select("k1", "b", "query_id", F.coalesce(F.col("dcg") / F.col("best"), F.lit(0.0)).alias("ndcg_at_5"))


def tuning_sample(judged: DataFrame, n: int = 400, share: float = 0.2, seed: int = 42) -> DataFrame:
    """query_id, held_out: n judged queries in drawn order, of which the first int(n share) are held out."""
    drawn = numbered(judged.select("query_id").distinct().withColumn("__d", draw(F.col("query_id"), seed=seed)), "__d", "query_id").where(F.col("number") < n)
    return drawn.crossJoin(F.broadcast(drawn.agg(F.count("*").alias("__n")))).select("query_id", (F.col("number") < F.floor(F.col("__n") * F.lit(share))).alias("held_out"))


def held_out_check(queries: DataFrame, ix: Index, qrels: DataFrame, split: DataFrame, grid: DataFrame) -> DataFrame:
    """setting, k1, b, n, ndcg_at_5: the best cell of the tuning queries, and the known settings, on the held-out ones."""
    best = best_cell(grid).first()
    settings = ([("best", best["k1"], best["b"])] if best else []) + [(name, *cell) for name, cell in KNOWN_SETTINGS.items()]
    dev = queries.join(split.where("held_out").select("query_id"), "query_id", "left_semi")
    cells = bm25_grid(dev, ix, qrels, sorted({(a, b) for _, a, b in settings}))
    means = cells.groupBy("k1", "b").agg(F.count("*").alias("n"), F.round(F.avg("ndcg_at_5"), 6).alias("ndcg_at_5"))
    named = queries.sparkSession.createDataFrame([(x, float(a), float(b)) for x, a, b in settings], "setting string, k1 double, b double")
    return named.join(means, ["k1", "b"]).select("setting", "k1", "b", "n", "ndcg_at_5")


def grid_means(cells: DataFrame) -> DataFrame:
    return cells.groupBy("k1", "b").agg(F.round(F.avg("ndcg_at_5"), 6).alias("ndcg_at_5"))


def best_cell(means: DataFrame) -> DataFrame:
    return means.orderBy(F.desc("ndcg_at_5"), "k1", "b").limit(1)


def held_out(queries: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """query_id, held_out: by drawn order, int(n share) of the queries are held out."""
    drawn = numbered(queries.select("query_id").withColumn("__d", draw(F.col("query_id"), seed=seed)), "__d", "query_id")
    return drawn.crossJoin(F.broadcast(drawn.agg(F.count("*").alias("__n")))).select("query_id", (F.col("number") < F.floor(F.col("__n") * F.lit(share))).alias("held_out"))


def stratified_split(rows: DataFrame, share: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds split: of each label, round-half-even(n share) rows go to val, in drawn order. rows(query_id, label)."""
    if not 0 < share < 1:
        raise ValueError("the share lies between 0 and 1")
    w = Window.partitionBy("label").orderBy(draw(F.col("query_id"), seed=seed), "query_id")
    n = F.count("*").over(Window.partitionBy("label"))
    return rows.withColumn("split", F.when(F.row_number().over(w) <= F.bround(n * F.lit(share)), "val").otherwise("train"))


def candidates(run: DataFrame, depth: int = 100) -> DataFrame:
    return run.where(F.col("rank") <= depth).select("query_id", "doc_id", "rank")


def hard_negatives(run: DataFrame, qrels: DataFrame, n: int = 30, skip_top: int = 20, seed: int = 42) -> DataFrame:
    """query_id, doc_id, pick: unjudged documents below the first skip_top ranks, n of each query in drawn order."""
    left, pair = run.where(F.col("rank") > skip_top), ["query_id", "doc_id"]
    # the run is small beside the judgements: only those of its rows are brought together with it
    left = left.join(qrels.select(*pair).join(small(left.select(*pair)), pair, "left_semi"), pair, "left_anti")
    w = Window.partitionBy("query_id").orderBy(draw(F.col("query_id"), F.col("doc_id"), seed=seed), "doc_id")
    return left.select("query_id", "doc_id", F.row_number().over(w).alias("pick")).where(F.col("pick") <= n)


def _there(qrels: DataFrame, run: DataFrame, collection: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Both without documents that collection(doc_id) does not have."""
    if collection is None:
        return qrels, run
    there = collection.select("doc_id")
    return qrels.join(there, "doc_id", "left_semi"), run.join(there, "doc_id", "left_semi")


def _negatives(qrels: DataFrame, run: DataFrame, n: int, skip_top: int, seed: int) -> DataFrame:
    """query_id, doc_id, at: judged zeros first, then hard negatives, n of each query in all, numbered from 1."""
    zero = qrels.where("grade = 0").select("query_id", "doc_id", F.lit(0).alias("kind"), F.lit(0).alias("pick"))
    hard = hard_negatives(run, qrels, n, skip_top, seed).select("query_id", "doc_id", F.lit(1).alias("kind"), "pick")
    w = Window.partitionBy("query_id").orderBy("kind", "pick", "doc_id")
    return zero.union(hard).withColumn("at", F.row_number().over(w)).where(F.col("at") <= n)


def training_examples(queries: DataFrame, qrels: DataFrame, run: DataFrame, n: int = 30, skip_top: int = 20, seed: int = 42, collection: DataFrame | None = None) -> DataFrame:
    """query_id, query, label, positives {doc: grade}, negatives [doc]: judged zeros first, then hard negatives, n in all.

    Queries without a positive drop out; those without negatives stay with an empty list. With `collection`(doc_id), documents that it does
    not have count for nothing.
    """
    qrels, run = _there(qrels, run, collection)
    positives = qrels.where("grade > 0").groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "grade")))).alias("positives"))
    negatives = _negatives(qrels, run, n, skip_top, seed).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), lambda x: x["doc_id"]).alias("negatives"))
    out = queries.select("query_id", "query", "label").join(positives, "query_id").join(negatives, "query_id", "left")
    return out.withColumn("negatives", F.coalesce("negatives", F.expr("cast(array() as array<string>)")))


def manifest_of(queries: DataFrame, splits: DataFrame, qrels: DataFrame, run: DataFrame, n: int = 30, skip_top: int = 20, seed: int = 42, collection: DataFrame | None = None) -> DataFrame:
    """manifest() of training_examples() of the same tables: rows are counted, and no query's documents become one row."""
    qrels, run = _there(qrels, run, collection)
    judged = qrels.groupBy("query_id").agg(F.count_if(F.col("grade") > 0).alias("positives"), F.count_if(F.col("grade") == 0).alias("zeros")).where("positives > 0")
    hard = hard_negatives(run, qrels, n, skip_top, seed).groupBy("query_id").agg(F.count("*").alias("hard"))
    rows = queries.select("query_id", "label").join(judged, "query_id").join(hard, "query_id", "left").join(splits.select("query_id", "split"), "query_id")
    negatives = F.least(F.col("zeros") + F.coalesce("hard", F.lit(0)), F.lit(n))
    return rows.groupBy("split", "label").agg(F.count("*").alias("queries"), F.sum("positives").cast("long").alias("positives"), F.sum(negatives).cast("long").alias("negatives"))


def manifest(examples: DataFrame, splits: DataFrame) -> DataFrame:
    """split, label, queries, positives, negatives."""
    rows = examples.join(splits.select("query_id", "split"), "query_id")
    return rows.groupBy("split", "label").agg(F.count("*").alias("queries"), F.sum(F.size("positives")).cast("long").alias("positives"), F.sum(F.size("negatives")).cast("long").alias("negatives"))


def relevant_sets(qrels: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, relevant: the ids of a query's relevant documents that the corpus has, in order."""
    rows = qrels.where("grade > 0").join(corpus.select("doc_id"), "doc_id", "left_semi")
    return rows.groupBy("query_id").agg(F.array_sort(F.collect_set("doc_id")).alias("relevant"))


def namespaced(papers: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """doc_id, text of papers and paragraphs as one corpus, ids beginning with paper_ or paragraph_."""
    each = [rows.select(F.concat(F.lit(f"{name}_"), "doc_id").alias("doc_id"), "text") for name, rows in (("paper", papers), ("paragraph", paragraphs))]
    return each[0].unionByName(each[1])


def overridden(background: DataFrame, own: DataFrame) -> DataFrame:
    """doc_id, text of both tables; of an id in both, the text of `own`."""
    rest = background.select("doc_id", "text").join(own.select("doc_id"), "doc_id", "left_anti")
    return rest.unionByName(own.select("doc_id", "text"))


def at_least(examples: DataFrame, grade: int = 1) -> DataFrame:
    """Examples with only the positives of that grade, without those that lose all."""
    kept = F.map_filter("positives", lambda _, v: v >= grade)
    return examples.withColumn("positives", kept).where(F.size("positives") > 0)


def with_texts(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """rows(pos_id, neg_id, ...) with positive and negative, texts(doc_id, text) in place of the ids.

    Texts are shuffled once for each document, never once for each row: the negatives are few, and are sent to where the positives are. Beyond what is
    broadcast they are shuffled as well.
    """
    rows, texts = stored(rows), texts.select("doc_id", "text")
    ids = [rows.select(F.col(c).alias("doc_id")).distinct() for c in ("pos_id", "neg_id")]
    sent = [small(x) for x in ids]
    positive = texts if sent[0] is ids[0] else texts.join(sent[0], "doc_id", "left_semi")
    negative = stored(texts.join(sent[1], "doc_id", "left_semi"))
    named = rows.join(positive.select(F.col("doc_id").alias("pos_id"), F.col("text").alias("positive")), "pos_id")
    return named.join(small(negative.select(F.col("doc_id").alias("neg_id"), F.col("text").alias("negative"))), "neg_id").drop("pos_id", "neg_id")


def training_triples(examples: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, anchor, positive, negative: the i-th positive with the i-th negative, from the first again at the end. texts(doc_id, text)."""
    ids = F.transform(F.array_sort(F.map_entries("positives")), lambda x: x["key"])
    rows = examples.where(F.size("negatives") > 0).select("query_id", F.col("query").alias("anchor"), F.posexplode(ids).alias("i", "pos_id"), "negatives")
    rows = rows.select("query_id", "anchor", "pos_id", F.element_at("negatives", F.col("i") % F.size("negatives") + 1).alias("neg_id"))
    return with_texts(rows, texts).select("query_id", "anchor", "positive", "negative")


def triples_of(queries: DataFrame, qrels: DataFrame, run: DataFrame, texts: DataFrame, n: int = 30, skip_top: int = 20, seed: int = 42, collection: DataFrame | None = None) -> DataFrame:
    """training_triples() of training_examples() of the same tables: positives are numbered as rows, and no query's documents become one row."""
    qrels, run = _there(qrels, run, collection)
    chosen = stored(_negatives(qrels, run, n, skip_top, seed).select("query_id", F.col("at").alias("__at"), F.col("doc_id").alias("neg_id")))
    asked = chosen.groupBy("query_id").agg(F.max("__at").alias("__n")).join(queries.select("query_id").distinct(), "query_id", "left_semi")
    placed = numbered_within(qrels.where("grade > 0").select("query_id", F.col("doc_id").alias("pos_id")).join(small(asked.select("query_id")), "query_id", "left_semi"), "query_id", "pos_id")
    rows = placed.join(small(asked), "query_id").select("query_id", "pos_id", (F.col("number") % F.col("__n") + 1).cast("int").alias("__at"))
    named = with_texts(rows.join(small(chosen), ["query_id", "__at"]).select("query_id", "pos_id", "neg_id"), texts)
    return named.join(small(queries.select("query_id", F.col("query").alias("anchor"))), "query_id").select("query_id", "anchor", "positive", "negative")


def training_pairs(queries: DataFrame, qrels: DataFrame, texts: DataFrame) -> DataFrame:
    """query_id, doc_id, query, text of relevant judgements whose query and document are there."""
    return qrels.where("grade > 0").join(queries.select("query_id", "query"), "query_id").join(texts.select("doc_id", "text"), "doc_id").select("query_id", "doc_id", "query", "text")


def validation_corpus(docs: DataFrame, qrels: DataFrame, run: DataFrame, distractors: int = 10_000, depth: int = 100, seed: int = 42) -> DataFrame:
    """doc_id, part: judged documents, candidates that are not judged, and drawn others."""
    judged = qrels.select("doc_id").distinct()
    near = candidates(run, depth).select("doc_id").distinct().join(judged, "doc_id", "left_anti")
    rest = docs.select("doc_id").join(judged, "doc_id", "left_anti").join(near, "doc_id", "left_anti").orderBy(draw(F.col("doc_id"), seed=seed), "doc_id").limit(distractors)
    return judged.select("doc_id", F.lit("judged").alias("part")).union(near.select("doc_id", F.lit("candidate"))).union(rest.select("doc_id", F.lit("distractor")))


def best_checkpoint(log: DataFrame, patience: int = 3) -> DataFrame:
    """One row of log(step, value): the best step, its value, and the step at which training with this patience stops (null: never)."""
    w = Window.orderBy("step")
    top = log.withColumn("before", F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    better = top.withColumn("better", F.coalesce(F.col("value") > F.col("before"), F.lit(True)).cast("int"))
    run = better.withColumn("run", F.sum("better").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    worse = run.withColumn("worse", F.row_number().over(Window.partitionBy("run").orderBy("step")) - 1)
    stop = worse.agg(F.min(F.when(F.col("worse") >= patience, F.col("step"))).alias("stopped_at"))
    seen = worse.crossJoin(F.broadcast(stop)).where("stopped_at is null or step <= stopped_at")
    return seen.groupBy("stopped_at").agg(F.min_by("step", F.struct(-F.col("value"), F.col("step"))).alias("step"), F.max("value").alias("value")).select("step", "value", "stopped_at")


def metric_column(columns: list[str], metric: str = "ndcg@10") -> str:
    """The evaluation column of a metric: eval_..._<metric>."""
    found = [c for c in columns if c.startswith("eval_") and c.endswith(metric)]
    if not found:
        raise KeyError(f"no evaluation column of {metric}")
    return found[0]


def curve(log: DataFrame, start: float, metric: str = "value") -> DataFrame:
    """step, value of a training curve, from the untrained model's value at step 0 on."""
    spark = log.sparkSession
    return spark.createDataFrame([(0, float(start))], "step long, value double").union(log.where(F.col(metric).isNotNull()).select("step", F.col(metric).alias("value"))).orderBy("step")
