"""Writers. Spark's commit protocol publishes a table as a whole or not at all."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.sources.commits import Change, Log
from rankloom.sources.readers import InputError

COLLECTIONS, QUERY_SETS = ("paper", "paragraph"), ("train", "study", "test")


def run_name(collection: str, model: str, query_set: str) -> str:
    if collection not in COLLECTIONS or query_set not in QUERY_SETS:
        raise InputError(f"unknown collection or query set: {collection}, {query_set}")
    return f"{collection}_{model}_{query_set}"


def run_lines(run: DataFrame, run_id: str, digits: int = 6) -> DataFrame:
    """query_id, rank, line of a run file."""
    if re.search(r"\s", run_id) or not run_id:
        raise InputError("a run id has no white space")
    line = F.concat_ws("\t", "query_id", F.lit("Q0"), "doc_id", F.col("rank").cast("string"), F.format_string(f"%.{digits}f", "score"), F.lit(run_id))
    return run.select("query_id", "rank", line.alias("line"))


def unsorted(run: DataFrame) -> DataFrame:
    """The rows whose score is above that of the row before."""
    before = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank"))
    return run.withColumn("before", before).where(F.col("score") > F.col("before"))


def write_run(run: DataFrame, path: str, run_id: str, digits: int = 6) -> None:
    bad = unsorted(run).limit(1).collect()
    if bad:
        raise InputError(f"scores of query {bad[0]['query_id']} are not sorted")
    run_lines(run, run_id, digits).orderBy("query_id", "rank").select("line").write.mode("overwrite").text(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def append_new(rows: DataFrame, path: str, key: str = "doc_id") -> int:
    """Appends the rows whose key is not in the table yet, so that a build goes on where it ended; the number of rows appended.

    The rows are made once: they are written to the table, and what is there is counted before and after.
    """
    from pyspark.errors import AnalysisException

    spark, before = rows.sparkSession, 0
    try:
        there = spark.read.parquet(path)
        before = there.count()
        rows = rows.join(there.select(key), key, "left_anti")
    except AnalysisException:
        pass
    rows.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before


def append_in_parts(rows: DataFrame, path: str, make, key: str = "doc_id", every: int = 50_000) -> int:
    """make(part) of all rows whose key is not in the table yet, in parts of about `every` rows; the number of rows appended. grown() reads it.

    Rows are dealt into parts by the hash of the key and written once, so that no part scans the others' rows. A part is written to a folder of its own and
    then committed, as many parts at a time as there are cores: what breaks off is not seen, and the next call does what is missing. The table's keys are read
    once a call; nothing but the parts themselves is counted.
    """
    spark, log = rows.sparkSession, Log(rows.sparkSession, path)
    if log.live()[0]:
        rows = rows.join(grown(spark, path).select(key), key, "left_anti")
    staged = f"{path}/staged/{uuid.uuid4().hex}"
    rows.withColumn("__part", F.pmod(F.xxhash64(key), F.lit(1 << 20))).write.parquet(staged)
    staged_rows = spark.read.schema(rows.schema.add("__part", "long")).parquet(staged)
    parts, done = -(-staged_rows.count() // every), 0  # by the footers
    if parts > 1:
        staged_rows.withColumn("__part", F.col("__part") % parts).repartition(parts, "__part").write.partitionBy("__part").parquet(f"{staged}-parts")
    split = staged_rows if parts < 2 else spark.read.schema(staged_rows.schema).parquet(f"{staged}-parts")
    made: list[DataFrame] = []
    version = None

    def commit() -> int:
        """Writes and commits the parts that are made, in one job for all."""
        nonlocal version
        if not made:
            return 0
        name = uuid.uuid4().hex
        together = reduce(DataFrame.unionByName, [m.withColumn("__at", F.lit(k)) for k, m in enumerate(made)])
        made.clear()
        together.write.partitionBy("__at").parquet(f"{path}/parts/{name}")
        sizes = {r["__at"]: r["count"] for r in spark.read.parquet(f"{path}/parts/{name}").groupBy("__at").count().collect()}
        if sizes:
            version = log.commit([Change("add", f"{name}/__at={k}", docs=n) for k, n in sorted(sizes.items())], version) + 1
        return sum(sizes.values())

    try:
        for k in range(parts):
            part = split if parts == 1 else split.where(F.col("__part") == k)
            made.append(make(part.drop("__part")))
            if len(made) == spark.sparkContext.defaultParallelism:
                done += commit()
    finally:
        done += commit()  # what was made before a later part broke off, too
    return done


def grown(spark, path: str) -> DataFrame:
    """The table that append_in_parts has committed so far."""
    there = Log(spark, path).live()[0]
    if not there:
        raise InputError(f"nothing is committed at {path}")
    return spark.read.parquet(*[f"{path}/parts/{c.name}" for c in there])


def save_sparse(weights: DataFrame, path: str, settings: dict) -> None:
    """weights(term, doc_id, weight), sorted by term as postings are, and the encoder's settings. Nothing to save is an error."""
    if weights.limit(1).count() == 0:
        raise InputError("no document was indexed: there is nothing to save")
    spark = weights.sparkSession
    weights.select("term", "doc_id", "weight").repartition("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/weights")
    _save_settings(spark, path, settings)


def save_dense(vectors: DataFrame, path: str, settings: dict) -> None:
    """vectors(doc_id, vector), all of one length, and the encoder's settings."""
    sizes = vectors.agg(F.count("*").alias("n"), F.min(F.size("vector")).alias("a"), F.max(F.size("vector")).alias("b"), F.count_distinct("doc_id").alias("k")).first()
    if not sizes["n"] or sizes["a"] != sizes["b"] or sizes["k"] != sizes["n"]:
        raise InputError("a vector index needs one vector for each id, all of one length")
    vectors.select("doc_id", "vector").write.mode("overwrite").parquet(f"{path}/vectors")
    _save_settings(vectors.sparkSession, path, settings | {"size": sizes["a"]})


def _save_settings(spark, path: str, settings: dict) -> None:
    rows = [(str(k), json.dumps(v)) for k, v in sorted(settings.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(f"{path}/settings")


def save_manifest(counts: DataFrame, path: str, settings: dict, empty_ids: DataFrame | None = None, config: str | None = None) -> None:
    """A collection's manifest: its one row of counts, its settings, and, if given, the ids of empty texts and the config file's text."""
    spark = counts.sparkSession
    named = counts.select(F.struct(*counts.columns).alias("counts"), F.lit(json.dumps(settings, sort_keys=True)).alias("settings"), F.current_timestamp().alias("created"))
    named.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    if empty_ids is not None:
        empty_ids.select("doc_id").write.mode("overwrite").text(f"{path}/empty_ids")
    if config is not None:
        spark.createDataFrame([(config,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/config")
