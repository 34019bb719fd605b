"""What the operators share: words, work folders, written intermediate tables, exact connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_OWN: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir. A local session without one, as in tests, gets a temporary folder, which goes
    when the process ends; what lies under a cluster's folder is for the cluster to clear, as results are read from it lazily."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="rankloom-"))
            atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
        base = _OWN[0]
    return f"{base.rstrip('/')}/rankloom/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, compression: str | None = None) -> DataFrame:
    """The same rows, read back from a Parquet table: cuts lineage, and a lost executor costs no recomputation."""
    df.write.mode("overwrite").parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def least_hashed(df: DataFrame, key: str, k: int, *ties: str) -> DataFrame:
    """The k rows of the least hashed keys. Rows far above the k-th are left out first, so that no task sorts or sends more than its share."""
    h, n = F.pmod(F.xxhash64(key), F.lit(1 << 30)), df.count()
    if n > 4 * k:
        near = df.where(h < int((1 << 30) * 2 * k / n))
        df = near if near.count() >= k else df
    return df.orderBy(h, key, *ties).limit(k)


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, group: str, order: list[Column], value: str, out: str, bucket: Column, buckets: int) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `group` that come before, in (bucket, order).

    `bucket` is a number below `buckets` by which a group's rows are dealt out, so that a group that holds most rows is still summed
    by many tasks: sums inside each (group, bucket), plus the sums of the buckets before it. The table of those has at most
    groups x buckets rows.
    """
    df = df.withColumn("__b", bucket.cast("int"))
    parts = df.groupBy(group, "__b").agg(F.sum(value).alias("__s"))
    ahead = Window.partitionBy(group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("__g"), F.col("__b").alias("__pb"), F.coalesce(F.sum("__s").over(ahead), F.lit(0)).cast("long").alias("__base"))
    inside = Window.partitionBy(group, "__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("__in", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    joined = df.join(parts, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__b") == F.col("__pb")))
    return joined.withColumn(out, F.col("__base") + F.col("__in")).drop("__b", "__pb", "__g", "__base", "__in")


def components(edges: DataFrame, path: str, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from each node that an edge (a, b) touches.

    Alternates the two star operations of Kiveris et al. (Connected Components in MapReduce and Beyond, 2014). Each round is written
    under `path`. A node of very high degree is no task of its own: its least neighbour is a partial aggregate, and the join that
    hands it out is one that adaptive execution splits.
    """
    spark = edges.sparkSession

    def both(e: DataFrame) -> DataFrame:
        return e.union(e.select(F.col("b"), F.col("a"))).toDF("u", "v")

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    def star(pairs: DataFrame, keep: Column, self_loop: bool) -> DataFrame:
        least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(F.col("u").alias("mu"), "m")
        out = pairs.join(least, F.col("u") == F.col("mu")).where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if self_loop:
            out = out.union(least.select(F.col("mu"), F.col("m")).toDF("a", "b"))
        return out.where("a <> b").distinct()

    e = written(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/round0")
    seen = state(e)
    for k in range(1, max_rounds + 1):
        large = star(both(e), F.col("v") > F.col("u"), False)
        # an edge (a, b) has a > b, so a's neighbours below it are its own rows; the star of a includes a itself
        small = star(large.toDF("u", "v"), F.lit(True), True)
        e = written(small, f"{path}/round{k}")
        now = state(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
