"""Operator 9, sharding by fixed virtual slots, in DataFrame functions only.

A record's doc_id hashes to one of a few thousand virtual slots, for good. A versioned table maps virtual slots to shards: version 0
deals slots out in turn; a rebalancing appends a version in which only the slots of overfull shards have moved. The map is bounded by
the number of slots, whatever the number of records. A stored map is edited, never begun again: the next call loads its last whole version.
"""

from __future__ import annotations

import math
from itertools import count

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import prefix_sums, table, work_dir, written

SLOTS = 8192
SHARDS = 8
MAP_SCHEMA = "version int, vslot int, shard int"


def virtual_slot(slots: int = SLOTS):
    """The virtual slot of a row with columns doc_id and text_crc32; rows without doc_id are dealt out by their text."""
    return F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text_crc32")).otherwise(F.xxhash64("doc_id")), F.lit(slots)).cast("int")


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot: all that sharding needs to know of a record."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")).withColumn("vslot", virtual_slot(slots))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: slots in turn."""
    return spark.range(slots).select(F.lit(0).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(current: DataFrame, slot_sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a slot map. Both inputs have a row per virtual slot at most.

    Each shard keeps its slots, largest first, while they fit under the mean load; what sticks out goes, largest first, to the shard
    that is least loaded by then. That fold is over the pool of moved slots, inside one row.
    """
    sized = current.join(slot_sizes, "vslot", "left").select("version", "vslot", "shard", F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    mean = sized.agg((F.sum("bytes") / shards).alias("mean"))
    order = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot")
    ranked = sized.withColumn("upto", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0))).crossJoin(F.broadcast(mean))
    ranked = ranked.withColumn("stays", (F.col("upto") <= F.col("mean")) & (F.col("shard") < shards))
    loads = ranked.groupBy().agg(
        F.max("version").alias("version"),
        F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.aggregate(F.collect_list(F.when(F.col("stays"), F.struct("shard", "bytes"))), F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["shard"] == s, x["bytes"]).otherwise(F.lit(0).cast("long")))).alias("loads"),
        F.array_sort(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("minus"), "vslot")))).alias("pool"),
    )
    start = F.struct(F.col("loads").alias("loads"), F.expr("cast(array() as array<struct<vslot:int,shard:int>>)").alias("moves"))

    def move(acc, x):
        # array_position is 1-based and finds the first of equals
        to = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        grown = F.transform(acc["loads"], lambda load, i: F.when(i == to, load - x["minus"]).otherwise(load))
        return F.struct(grown.alias("loads"), F.concat(acc["moves"], F.array(F.struct(x["vslot"].alias("vslot"), to.alias("shard")))).alias("moves"))

    moved = loads.select("version", F.explode(F.aggregate("pool", start, move)["moves"]).alias("m")).select(F.col("m.vslot").alias("moved_slot"), F.col("m.shard").alias("to"))
    return ranked.join(moved, F.col("vslot") == F.col("moved_slot"), "left").select((F.col("version") + 1).cast("int").alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))


def spread(slot_map: DataFrame, slot_sizes: DataFrame, shards: int) -> float:
    """Bytes between the fullest and the emptiest shard; infinite if a virtual slot is on a shard that is no more."""
    loads = slot_map.join(slot_sizes, "vslot", "left").groupBy("shard").agg(F.sum(F.coalesce("bytes", F.lit(0))).alias("load"))
    r = loads.agg(F.max("load").alias("a"), F.min("load").alias("b"), F.count("*").alias("n"), F.max("shard").alias("last")).first()
    return math.inf if r["last"] >= shards else r["a"] - (r["b"] if r["n"] == shards else 0)


def settled(current: DataFrame, slot_sizes: DataFrame, shards: int) -> DataFrame:
    """The map after edits that each bring the shards nearer to one another; `current` itself if there is none."""
    path = work_dir(current.sparkSession)
    best, wide = current, spread(current, slot_sizes, shards)
    for k in count():
        edited = written(rebalanced(best, slot_sizes, shards), f"{path}/edit{k}")
        now = spread(edited, slot_sizes, shards)
        if now >= wide:
            return best
        best, wide = edited, now


def save_map(slot_map: DataFrame, path: str) -> int:
    """Stores a version of the map (one number in `version`, a row per virtual slot) under `path`/version=n; earlier ones stay readable.

    A version is a folder of its own, which Spark's committer marks as whole. The same version can be stored again, with the same rows, as a
    rerun does; storing other rows under a number that is taken is an error, and so is a virtual slot that occurs twice.
    """
    spark, facts = slot_map.sparkSession, slot_map.agg(F.min("version").alias("a"), F.max("version").alias("b"), F.count("*").alias("n"), F.count_distinct("vslot").alias("k")).first()
    if facts["n"] != facts["k"] or facts["a"] is None or facts["a"] != facts["b"]:
        raise ValueError("a map has one version, and each virtual slot once")
    if facts["a"] in stored_versions(spark, path):
        there = load_map(spark, path, facts["a"]).select("vslot", "shard")
        if there.count() != facts["n"] or there.exceptAll(slot_map.select("vslot", "shard")).limit(1).count():
            raise ValueError(f"version {facts['a']} of the map is taken")
    else:
        slot_map.select("vslot", "shard").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={facts['a']}")
    return facts["a"]


def stored_versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of the whole versions under `path`, rising. A folder without the committer's mark, as a lost driver leaves it, is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    found = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(at)]
    return sorted(int(n.removeprefix("version=")) for n, p in found if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{p}/_SUCCESS")))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """version, vslot, shard of one version of the stored map; by default the last whole one."""
    known = stored_versions(spark, path)
    version = max(known, default=None) if version is None else version
    if version not in known:
        raise ValueError(f"no version {version} of the map under {path}")
    rows = spark.read.schema("vslot int, shard int").parquet(f"{path}/version={version}")
    return rows.select(F.lit(version).alias("version"), "vslot", "shard")


#: Parts into which the rows of a virtual slot are dealt for numbering: one id may have many texts.
PARTS = 32


def addressed(rows: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Adds shard, and slot: the record's place in its shard, 0 upwards without gaps, by vslot and, inside, by part, doc_id, size, text_crc32.

    Equal records are counted before anything is shuffled, numbered as one, and dealt out again, so that an id or a text that very many
    records share is no task of its own. Places are sums over the shard's earlier virtual slots and over the earlier records of the own one.
    """
    kinds = rows.groupBy("vslot", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n"))
    counts = rows.groupBy("vslot").agg(F.count("*").alias("n")).join(F.broadcast(slot_map.select("vslot", "shard")), "vslot")
    ahead = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("vslot").alias("base_slot"), "shard", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    part = F.pmod(F.xxhash64("size", "text_crc32"), F.lit(PARTS))
    placed = prefix_sums(kinds, "vslot", ["doc_id", "size", "text_crc32"], "n", "before", part, PARTS)
    placed = placed.join(F.broadcast(base), F.col("vslot") == F.col("base_slot"))
    return placed.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("slot", (F.col("base") + F.col("before") + F.col("at")).cast("long")).drop("at", "n", "before", "base", "base_slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, map_version per row of docs(doc_id, text).

    Law `bytes`: the shards' sizes are near equal. A null text has size 1 and the checksum of the empty text; a null doc_id is hashed
    by its text; repeated rows are records of their own and take adjacent places; an empty table gives an empty result; other columns
    are not looked at. The map under `map_path` (a new folder by default, in which version 0 deals slots out in turn) is loaded, edited
    for these records, and stored as its next version; if it holds already, as on a rerun, no version is added.
    """
    spark = docs.sparkSession
    path = map_path or f"{work_dir(spark)}/slot_map"
    rows = records(docs, slots)
    sizes = written(rows.groupBy("vslot").agg(F.sum("size").alias("bytes")), f"{work_dir(spark)}/sizes")
    if not stored_versions(spark, path):
        save_map(first_map(spark, shards, slots), path)
    current = load_map(spark, path)
    if current.count() != slots:
        raise ValueError(f"the map under {path} does not have {slots} virtual slots")
    version, edited = current.first()["version"], settled(current, sizes, shards)
    if edited is not current:
        version = save_map(edited.withColumn("version", F.lit(version + 1)), path)
    placed = addressed(rows, load_map(spark, path, version))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("map_version"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
