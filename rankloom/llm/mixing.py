"""Operator 4, mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Each source's documents, in hashed order, form one stream of words that is cut into blocks of equal token count. Slot i of the schedule
takes the point frac(i x golden ratio), which falls into the interval of one source in the cumulated weights; the k-th slot of a source
takes the k-th block of its stream, which starts again at its end. A prefix of the schedule of any length has the target mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import n_words, prefix_sums, table, work_dir, written

WEIGHTS = (5, 2, 1)
#: No source's target is above this many times its size.
MAX_EPOCHS = 3
BLOCK_WORDS = 1024
#: frac(golden ratio), and frac(2^20 x golden ratio): a slot number is split in two, so that points stay exact to 2^-40 or so.
PHI, PHI_20, LOW = 0.6180339887498949, 0.5779302058079734, 1 << 20
#: Documents (schedule slots) that one bucket of a source's running sums holds, about.
BUCKET_ROWS = 4096


def point(i: Column) -> Column:
    """frac(i x golden ratio) for i from 0."""
    x = (i / F.lit(LOW)).cast("long") * F.lit(PHI_20) + (i % LOW) * F.lit(PHI)
    return x - F.floor(x)


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """A document's place in its source's hashed order; SQL engines agree on it."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _key(text: Column, source: Column) -> Column:
    return F.xxhash64(text.cast("string"), source.cast("string"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target, for sizes(source, source_size) with a row per source.

    Weights go to the sources by code point (null last), in turn. The mix has `share` of all words. A source's target stops at
    max_epochs x its size; what is over goes to the others by weight until none is above. That fixed point is found at once: by rising
    size per weight, sources are capped until the level reached by the rest, (budget - caps) / (their weights), fits them all.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    w = w.withColumn("capped", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("rest", F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
    budget = F.sum("source_size").over(everything) * F.lit(share)
    w = w.withColumn("level", (budget - F.col("capped")) / F.col("rest"))
    # the first source, in that order, that the level of it and all later ones fits
    w = w.withColumn("final", F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(everything)["level"])
    return w.select("source", "source_size", F.coalesce(F.least(F.col("final") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def schedule(plan: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(source, rank, i): the k-th slot of each source and its place in the whole schedule. plan: source, source_size, target, goal, need.

    Points are mapped to sources by an equality join on cells of [0, 1): a source has a row for each cell that its interval meets, a
    point lies in one cell. Ranks are two-level sums over chunks of the schedule. Slots over a source's need are left out; slots that
    the points leave short (a few per source) come last.
    """
    spark = plan.sparkSession
    total = plan.agg(F.sum("target").alias("t"), F.sum("need").alias("n"), F.count("*").alias("k")).first()
    slots, cells = int(total["n"] or 0), 4 * int(total["k"]) + 4
    cumulated = Window.orderBy(F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, 0)
    ends = plan.select("source", "need", F.col("target"), F.sum("target").over(cumulated).alias("hi_t"))
    ends = ends.where("target > 0").withColumn("hi", F.col("hi_t") / F.lit(total["t"] or 1.0)).withColumn("lo", (F.col("hi_t") - F.col("target")) / F.lit(total["t"] or 1.0))
    # the last interval also takes the points that rounding leaves beyond its end
    ends = ends.withColumn("hi", F.when(F.col("hi_t") == F.max("hi_t").over(Window.partitionBy()), F.lit(2.0)).otherwise(F.col("hi")))
    ends = ends.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells).cast("int"), F.floor(F.least("hi", F.lit(1.0)) * cells).cast("int"))))
    points = spark.range(slots).select(F.col("id").alias("i"), point(F.col("id")).alias("p")).withColumn("pc", F.floor(F.col("p") * cells).cast("int"))
    hits = points.join(ends, (F.col("pc") == F.col("cell")) & (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi"))).select("source", "i", "need", F.lit(1).alias("one"))
    ranked = prefix_sums(hits, "source", ["i"], "one", "rank", F.col("i") / F.lit(BUCKET_ROWS), 0).where("rank < need").select("source", "rank", "i")
    # plan rows keep their sources even where no point fell
    got = ranked.groupBy("source").agg(F.count("*").alias("got")).withColumnRenamed("source", "got_source")
    short = plan.join(got, F.col("source").eqNullSafe(F.col("got_source")), "left").where("coalesce(got, 0) < need")
    closing = short.select("source", F.explode(F.sequence(F.coalesce(F.col("got"), F.lit(0)).cast("long"), (F.col("need") - 1).cast("long"))).alias("rank"))
    return ranked.union(closing.select("source", "rank", (F.lit(slots) + F.col("rank")).cast("long")))


def mix_documents(docs: DataFrame, weights: tuple = WEIGHTS, share: float = 1.0, max_epochs: int = MAX_EPOCHS, block_words: int = BLOCK_WORDS, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, taken, key per row of docs(doc_id, text, source); `key` is a hash of text and source.

    size: words of the text, null 0. target: words that the mix should take from the row's source. taken: words that it takes from this
    row, repeats counted; at most max_epochs x size; 0 for empty texts. A source's taken words are its target, rounded. A null source is
    a source of its own, the last. Repeated rows are documents of their own. An empty table gives an empty result; other columns are
    not looked at. Reruns agree, but which of several rows with one doc_id, size and text comes first is open, and shows nowhere.
    """
    spark = docs.sparkSession
    path = work_dir(spark)
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), _key(F.col("text"), F.col("source")).alias("key"))
    rows = written(rows.withColumn("order", shuffle_key(F.col("doc_id"), seed)), f"{path}/rows")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    blocks = F.ceil(F.col("source_size") / block_words)
    plan = plan.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    # slots of whole passes through the stream, then blocks of the last, partial pass
    plan = plan.withColumn("need", F.when(F.col("source_size") > 0, F.expr("goal div source_size") * blocks + F.ceil((F.col("goal") % F.when(F.col("source_size") > 0, F.col("source_size"))) / block_words)).otherwise(F.lit(0)).cast("long"))
    plan = written(plan, f"{path}/plan")
    slots = schedule(plan, block_words).join(plan.select(F.col("source").alias("ps"), "source_size", "goal"), F.col("source").eqNullSafe(F.col("ps")))
    per_pass = F.ceil(F.col("source_size") / block_words)
    slots = slots.withColumn("block", (F.col("rank") % per_pass).cast("long")).withColumn("turn", F.floor(F.col("rank") / per_pass).cast("long"))
    # the words of a block that the slot takes: all, but for the slot in which the source's goal is reached
    begin = F.col("turn") * F.col("source_size") + F.col("block") * F.lit(block_words)
    length = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * F.lit(block_words))
    slots = slots.withColumn("words", F.least(length, F.col("goal") - begin)).withColumn("full", F.col("words") == length)
    taken = slots.groupBy("source", "block").agg(F.count(F.when(F.col("full"), 1)).alias("times"), F.coalesce(F.max(F.when(~F.col("full"), F.col("words"))), F.lit(0)).cast("long").alias("part"))
    # each document's words in its source's stream, cut at the blocks' ends
    buckets = max(1, rows.count() // BUCKET_ROWS)
    bucket = F.floor(F.conv(F.substring("order", 1, 7), 16, 10).cast("long") * buckets / F.lit(1 << 28))
    placed = prefix_sums(rows, "source", ["order", "doc_id", "size", "key"], "size", "begin", bucket, buckets)
    facts = F.broadcast(plan.select(F.col("source").alias("fs"), "source_size", "target")) if plan.count() <= 100_000 else plan.select(F.col("source").alias("fs"), "source_size", "target")
    pieces = placed.where("size > 0").select("source", "begin", "size", F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("begin") + F.col("size") - 1) / block_words))).alias("piece"))
    hit = pieces.join(taken.select(F.col("source").alias("ts"), "block", "times", "part"), F.col("source").eqNullSafe(F.col("ts")) & (F.col("piece") == F.col("block")))
    first = F.greatest(F.col("begin") - F.col("piece") * F.lit(block_words), F.lit(0))
    last = F.least(F.col("begin") + F.col("size") - F.col("piece") * F.lit(block_words), F.lit(block_words))
    words = (last - first) * F.col("times") + F.greatest(F.least(last, F.col("part")) - first, F.lit(0))
    # (source, begin) tells apart the documents that have words
    sums = hit.groupBy(F.col("source").alias("ss"), F.col("begin").alias("sb")).agg(F.sum(words).cast("long").alias("sum"))
    out = placed.join(sums, F.col("source").eqNullSafe(F.col("ss")) & (F.col("begin") == F.col("sb")) & (F.col("size") > 0), "left")
    out = out.join(facts, F.col("source").eqNullSafe(F.col("fs")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("sum", F.lit(0)).cast("long").alias("taken"), "key")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them: a row of which it takes q passes and a part stays q
    times, and once more if the part is half of the row or more. Rows that are taken less than half go, as do rows without words.

    Rows that share doc_id, source and text are put apart again by their number, so that the words of all of them come out right. A null
    source is one of its own; null and empty texts have no words and go; ids may be null; an empty table stays empty.
    """
    found = mix_documents(docs, **options)
    times = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0)
    # equal rows differ in `taken` by their place alone; together they stay as often as the sum of their times
    times = found.groupBy(F.col("doc_id").alias("__rl_id"), F.col("key").alias("__rl_key")).agg(F.sum(times).cast("int").alias("__rl_sum"), F.count("*").alias("__rl_rows")).where("__rl_sum > 0")
    times = written(times, f"{work_dir(docs.sparkSession)}/times")
    # the times grow with the documents: they are never broadcast
    out = docs.join(times.hint("merge"), docs["doc_id"].eqNullSafe(F.col("__rl_id")) & (_key(docs["text"], docs["source"]) == F.col("__rl_key")))
    one = out.where("__rl_rows = 1")
    # equal rows are made one, then dealt out again
    many = out.where("__rl_rows > 1").dropDuplicates(["doc_id", "text", "source"])
    return one.union(many).withColumn("__rl_copy", F.explode(F.sequence(F.lit(1), F.col("__rl_sum")))).select(*docs.columns)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_documents(table(spark, sf_dir, "documents")).drop("key").withColumn("target", F.round("target", 3))


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size, md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, CAST(source_size AS DOUBLE) * 3 AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT arg_min(level, cap / w) FILTER (WHERE level * w <= cap) AS final FROM l),
t AS (SELECT source, source_size, CAST(least(coalesce(final, 1e300) * w, cap) AS DOUBLE) AS target FROM l, f),
p AS (SELECT d.*, source_size, target, CAST(floor(target + 0.5) AS BIGINT) AS goal,
  coalesce(CAST(sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  CAST(CASE WHEN size = 0 THEN 0 ELSE size * (goal // source_size) + greatest(least(b + size, goal % source_size) - b, 0) END AS BIGINT) AS taken FROM p
"""
