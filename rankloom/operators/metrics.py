"""Retrieval metrics per query, their means, comparisons. run(query_id, doc_id, rank, ...); qrels(query_id, doc_id, grade)."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.ranking import small


def strict(qrels: DataFrame, grade: int = 2) -> DataFrame:
    """Only the highest grade; queries without it drop out."""
    return qrels.where(F.col("grade") == grade)


def judged(run: DataFrame, qrels: DataFrame, by: tuple = ("query_id",)) -> DataFrame:
    """run rows with their grades, 0 if unjudged. Queries without judgements drop out. Of the judgements, only those of the run's rows are brought together with it."""
    pair = [*by, "doc_id"]
    known = run.join(small(qrels.select(*by).distinct()), [*by], "left_semi")
    named = qrels.select(*pair, "grade").join(small(run.select(*pair).distinct()), pair, "left_semi")
    return known.join(named, pair, "left").withColumn("grade", F.coalesce("grade", F.lit(0)))


def _gain(grade: Column, exponential: bool) -> Column:
    return F.pow(F.lit(2.0), grade) - 1 if exponential else grade.cast("double")


def dcg(rows: DataFrame, k: int, exponential: bool = False, name: str = "dcg") -> DataFrame:
    return rows.where(F.col("rank") <= k).groupBy("query_id").agg(F.sum(_gain(F.col("grade"), exponential) / F.log2(F.col("rank") + 1.0)).alias(name))


def ideal(qrels: DataFrame, by: tuple = ("query_id",)) -> DataFrame:
    """The judged documents of each query, best first."""
    w = Window.partitionBy(*by).orderBy(F.desc("grade"), "doc_id")
    return qrels.where("grade > 0").withColumn("rank", F.row_number().over(w))


def per_query(run: DataFrame, qrels: DataFrame, k: int = 100, shared: tuple = (), own: tuple = (), every: Column | None = None) -> DataFrame:
    """query_id and all metrics, for every judged query; a query that the run misses, or without relevant documents, has 0.

    Many runs at once: `shared` are further keys of run and qrels, `own` those of run alone, of which `every` makes a row each for a judged query. What
    judgements alone say is made once for all of these.
    """
    at = (*shared, "query_id")
    rows = judged(run.where(F.col("rank") <= k), qrels, at)
    hit = F.col("grade") >= 1
    found = rows.groupBy(*own, *at).agg(
        *[F.count_if(hit & (F.col("rank") <= n)).alias(f"h{n}") for n in (1, 5, 10, 100)],
        F.min(F.when(hit, F.col("rank"))).alias("first"),
        *[F.sum(F.when(F.col("rank") <= n, _gain(F.col("grade"), e) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"d{int(e)}_{n}") for n in (5, 10, 100) for e in (False, True)],
    )
    first = ideal(qrels, at).where("rank <= 100")  # no metric looks further: Spark keeps no more of a task
    best = first.groupBy(*at).agg(*[F.sum(F.when(F.col("rank") <= n, _gain(F.col("grade"), e) / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"i{int(e)}_{n}") for n in (5, 10, 100) for e in (False, True)])
    relevant = qrels.groupBy(*at).agg(F.count_if(hit).alias("relevant"))
    wanted = relevant.join(best, [*at], "left")
    if every is not None:
        wanted = wanted.withColumn(own[0], every)
    all_ = wanted.join(found, [*own, *at], "left")
    share = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.col(b)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return all_.select(
        *shared,
        *own,
        "query_id",
        share("d0_100", "i0_100").alias("ndcg"),
        share("d0_5", "i0_5").alias("ndcg_at_5"),
        share("d0_10", "i0_10").alias("ndcg_at_10"),
        share("d1_100", "i1_100").alias("ndcg_exp"),
        share("d1_5", "i1_5").alias("ndcg_exp_at_5"),
        zero(1.0 / F.col("first")).alias("mrr"),
        zero(F.when(F.col("first") <= 10, 1.0 / F.col("first"))).alias("mrr_at_10"),
        zero(F.col("h5") / 5.0).alias("p_at_5"),
        zero(F.col("h10") / 10.0).alias("p_at_10"),
        *[share(f"h{n}", "relevant").alias(f"recall_at_{n}") for n in (5, 10, 100)],
        *[zero((F.col(f"h{n}") > 0).cast("double")).alias(f"accuracy_at_{n}") for n in (1, 5, 10)],
    )


def ndcg_list_local(run: DataFrame, qrels: DataFrame, k: int = 100) -> DataFrame:
    """nDCG whose ideal is the best order of what was retrieved, with exponential gain."""
    rows = judged(run, qrels).where(F.col("rank") <= k)
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    best = dcg(rows.withColumn("rank", F.row_number().over(w)), k, True, "best")
    both = dcg(rows, k, True).join(best, "query_id")
    return both.select("query_id", F.when(F.col("best") > 0, F.col("dcg") / F.col("best")).otherwise(0.0).alias("ndcg"))


def means(metrics: DataFrame, by: tuple = ()) -> DataFrame:
    cols = [c for c, t in metrics.dtypes if t == "double"]
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def paired_differences(metrics: DataFrame, metric: str) -> DataFrame:
    """query_id, model_a, model_b, d for each two models; metrics(model, query_id, metric)."""
    a = metrics.select("query_id", F.col("model").alias("model_a"), F.col(metric).alias("x"))
    b = metrics.select("query_id", F.col("model").alias("model_b"), F.col(metric).alias("y"))
    return a.join(b, "query_id").where("model_a < model_b").select("query_id", "model_a", "model_b", (F.col("x") - F.col("y")).alias("d"))


def paired_t(metrics: DataFrame, metric: str) -> DataFrame:
    """model_a, model_b, n, mean_d, t. Equal runs have no t."""
    d = paired_differences(metrics, metric).groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg("d").alias("mean_d"), F.stddev_samp("d").alias("sd"))
    return d.select("model_a", "model_b", "n", "mean_d", F.when(F.col("sd") > 0, F.col("mean_d") / (F.col("sd") / F.sqrt("n"))).alias("t"))


#: Rows of a report by setting.
GRADED, STRICT = ("ndcg", "ndcg_at_5", "mrr", "p_at_5", "p_at_10", "recall_at_100"), ("mrr", "p_at_5")
#: Differences are marked below this probability; draws of the randomization tests.
MAX_P, DRAWS = 0.05, 1000


def by_model(runs: DataFrame, qrels: DataFrame, models: list[str]) -> DataFrame:
    """model, query_id and all metrics of runs(model, ...); a query that a model does not answer counts as 0."""
    return per_query(runs, qrels, own=("model",), every=F.explode(F.array(*map(F.lit, models))))


def report(runs: DataFrame, qrels: DataFrame, models: dict[str, list[str]]) -> DataFrame:
    """collection, setting, model, metric, value: means over the judged queries, graded, and strict (highest grade alone).

    runs and qrels have a column collection; models are those of each collection. All are measured in one pass.
    """
    named = F.create_map(*[x for c, m in models.items() for x in (F.lit(c), F.array(*map(F.lit, m)))])
    settings = F.explode(F.array(F.lit("graded"), F.lit("strict")))
    judged_ = qrels.withColumn("setting", settings).where("setting = 'graded' or grade = 2")
    keys = ["collection", "setting", "model"]
    rows = per_query(runs.withColumn("setting", settings), judged_, shared=("collection", "setting"), own=("model",), every=F.explode(named[F.col("collection")]))
    means_ = rows.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in GRADED])
    return means_.unpivot(keys, list(GRADED), "metric", "value").where((F.col("setting") == "graded") | F.col("metric").isin(*STRICT))


def student_p(t: Column, n: Column) -> Column:
    """Two-sided p of Student's t with n - 1 degrees of freedom, by the finite series that whole degrees have; 1 without t."""
    v = (n - 1).cast("int")
    angle = F.atan(F.abs(t) / F.sqrt(v.cast("double")))
    c, odd = F.cos(angle), v % 2 == 1
    first = F.when(odd, c).otherwise(F.lit(1.0))
    last = F.when(odd, F.floor((v - 3) / 2)).otherwise(F.floor((v - 2) / 2)).cast("int")
    steps = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.expr("cast(array() as array<int>)"))
    ratio = lambda j: F.when(odd, 2 * j / (2 * j + 1)).otherwise((2 * j - 1) / (2 * j))
    start = F.struct(first.alias("a"), F.when(last >= 0, first).otherwise(F.lit(0.0)).alias("s"))

    def step(acc, j):
        a = acc["a"] * c * c * ratio(j)
        return F.struct(a.alias("a"), (acc["s"] + a).alias("s"))

    series = F.sin(angle) * F.aggregate(steps, start, step)["s"]
    inside = F.when(odd, 2 / F.pi() * (angle + series)).otherwise(series)
    return F.when(t.isNull() | (n < 2), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - inside))


def significance(metrics: DataFrame, metric: str) -> DataFrame:
    """model_a, model_b, n, mean_d, t, p, significant: paired two-sided t-tests of each two models. Equal runs have p 1."""
    rows = paired_t(metrics, metric).withColumn("p", student_p(F.col("t"), F.col("n")))
    return rows.withColumn("significant", F.col("p") < MAX_P)


#: Queries whose signs a task keeps.
KEPT_SIGNS = 10_000


def randomization(metrics: DataFrame, metric: str, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """model_a, model_b, n, mean_d, p: Fisher's randomization test. Each draw turns the signs of the queries' differences by a seeded hash;
    p is the share of draws, the observed one among them, whose mean is as far from 0."""
    d = paired_differences(metrics, metric)
    seen = d.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.round(F.avg("d"), 9).alias("mean_d"))

    def summed(batches: Iterator) -> Iterator:
        """Sums of all draws, side by side, of what a task has of each pair."""
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        signs: dict = {}
        for b in batches:
            for model_a, model_b, query, x in zip(*(c.to_pylist() for c in b.columns)):
                if query not in signs:
                    if len(signs) == KEPT_SIGNS:
                        signs.clear()
                    signs[query] = np.array([-1.0 if hashlib.md5(f"{seed}-{k}-{query}".encode()).digest()[1] & 1 else 1.0 for k in range(1, draws + 1)])
                key = (model_a, model_b)
                sums[key] = sums.get(key, 0.0) + signs[query] * x
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums]), pa.array([k[1] for k in sums]), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["model_a", "model_b", "sums"])

    sums = d.select("model_a", "model_b", "query_id", F.col("d").cast("double")).mapInArrow(summed, "model_a string, model_b string, sums array<double>")
    means = sums.select("model_a", "model_b", F.posexplode("sums").alias("draw", "s")).groupBy("model_a", "model_b", "draw").agg(F.sum("s").alias("s"))
    far = means.join(seen, ["model_a", "model_b"]).groupBy("model_a", "model_b", "n", "mean_d").agg(F.count_if(F.abs(F.round(F.col("s") / F.col("n"), 9)) >= F.abs("mean_d")).alias("far"))
    return far.select("model_a", "model_b", "n", "mean_d", ((F.col("far") + 1) / F.lit(draws + 1)).alias("p"))


def tukey(metrics: DataFrame, metric: str, draws: int = DRAWS, seed: int = 42) -> DataFrame:
    """model_a, model_b, mean_d, p: Tukey's honestly significant differences by randomization. Each draw shuffles every query's scores among
    the models by a seeded hash; p is the share of draws, the observed one among them, whose largest mean exceeds the least by as much."""
    rows = metrics.select("model", "query_id", F.col(metric).alias("x"))
    means = rows.groupBy("model").agg(F.round(F.avg("x"), 9).alias("mean"))

    def seated(batches: Iterator) -> Iterator:
        """Sums and counts of all draws and seats, of what a task has of the queries."""
        import numpy as np
        import pyarrow as pa

        sums = counts = np.zeros((draws, 0))
        for b in batches:
            for query, scores in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                m = len(scores)
                if m > sums.shape[1]:
                    more = ((0, 0), (0, m - sums.shape[1]))
                    sums, counts = np.pad(sums, more), np.pad(counts, more)
                models, x = [r["model"] for r in scores], np.array([r["x"] for r in scores], float)
                for k in range(draws):
                    order = sorted(range(m), key=lambda i: (hashlib.md5(f"{seed}-{k + 1}-{query}-{models[i]}".encode()).digest(), models[i]))  # noqa: B023
                    sums[k, :m] += x[order]
                counts[:, :m] += 1
        if sums.shape[1]:
            draw, seat = np.indices(sums.shape)
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel(), t) for v, t in ((draw, pa.int32()), (seat, pa.int32()), (sums, pa.float64()), (counts.astype(np.int64), pa.int64()))], ["draw", "seat", "s", "n"])

    by_query = rows.groupBy("query_id").agg(F.collect_list(F.struct("model", "x")).alias("scores"))  # as many as there are models
    seats = by_query.mapInArrow(seated, "draw int, seat int, s double, n long").groupBy("draw", "seat").agg(F.round(F.sum("s") / F.sum("n"), 9).alias("m"))
    ranges = seats.groupBy("draw").agg(F.round(F.max("m") - F.min("m"), 9).alias("range"))
    a, b = means.toDF("model_a", "x"), means.toDF("model_b", "y")
    pairs = a.join(b, F.col("model_a") < F.col("model_b")).select("model_a", "model_b", F.round(F.col("x") - F.col("y"), 9).alias("mean_d"))
    far = pairs.crossJoin(ranges).groupBy("model_a", "model_b", "mean_d").agg(F.count_if(F.col("range") >= F.abs("mean_d")).alias("far"))
    return far.select("model_a", "model_b", "mean_d", ((F.col("far") + 1) / F.lit(draws + 1)).alias("p"))


TESTS = {"student": significance, "fisher": randomization, "tukey": tukey}

# What models are called in tables.
DISPLAY_NAMES = {"bm25": "BM25", "tfidf": "TF-IDF", "dense": "Dense", "sparse": "SPLADE", "sparse_zeroshot": "SPLADE (zero-shot)"}


def display_name(model: str) -> str:
    """rrf:a+b is the fusion of a and b."""
    if model.startswith("rrf:"):
        return f"RRF({'+'.join(DISPLAY_NAMES.get(m, m) for m in model.removeprefix('rrf:').split('+'))})"
    return DISPLAY_NAMES.get(model, model)


def display_names(model: Column) -> Column:
    """display_name() of a column."""
    names = F.create_map(*[F.lit(x) for kv in DISPLAY_NAMES.items() for x in kv])
    one = lambda m: F.coalesce(names[m], m)
    parts = F.transform(F.split(F.substring(model, 5, 1000), r"\+"), one)
    return F.when(F.startswith(model, F.lit("rrf:")), F.concat(F.lit("RRF("), F.array_join(parts, "+"), F.lit(")"))).otherwise(one(model))


def t_p_value(t: float, n: int) -> float:
    """Two-sided p of Student's t with n - 1 degrees of freedom, by the continued fraction of the incomplete beta function."""
    df = n - 1
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0

    def fraction(a: float, b: float, x: float) -> float:
        tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
        d = 1 / (d if abs(d) > tiny else tiny)
        h = d
        for m in range(1, 500):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
                h *= d * c
            if abs(d * c - 1) < 1e-14:
                break
        return h

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b
