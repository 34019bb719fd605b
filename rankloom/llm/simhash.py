"""Operator 1, SimHash near-dedup with multi-index hashing.

Fingerprints of 64 bits are cut into two halves. If two differ in at most 3 bits, one of the halves differs in at most 1: so each
fingerprint is stored under both its halves, and looks up, for both, the 33 values within one bit. What an equality join finds is
verified over all 64 bits. A value of a half that very many fingerprints share is looked up with a byte of the other half as well (of
its 4 bytes, at least one is equal when 3 bits differ), which cuts such buckets 256-fold and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import components, table, work_dir, written

SEED = 42
SHINGLE = 3
MAX_DISTANCE = 3
#: Fingerprints under one value of a half from which on a byte of the other half is part of the key.
LARGE_BUCKET = 128

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a text's word shingles as an unsigned number; 0 for a text without words."""
    import numpy as np
    import xxhash

    # bytes.split() cuts at 0x20 and 0x09-0x0D exactly
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    digest = xxhash.xxh64_digest
    h = b"".join([digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())])
    ones, at = np.zeros(64, np.int64), np.frombuffer(h, np.uint8).reshape(n, 8)
    for k in range(0, n, 65536):
        ones += np.unpackbits(at[k : k + 65536], axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        *keys, text = batch.columns
        texts = text.cast(pa.binary())
        fps = [fingerprint(texts[i].as_py()) for i in range(len(texts))]
        yield pa.RecordBatch.from_arrays([*keys, pa.array([f - (1 << 64) if f >> 63 else f for f in fps], pa.int64())], [*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), fp (signed) per row."""
    named = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    return named.mapInArrow(_fingerprints, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def links(nodes: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints of nodes(fp) that differ in at most 3 bits."""
    half = F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("fp", 32).alias("key")), F.struct(F.lit(1).alias("side"), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)).alias("key")))
    stored = nodes.select("fp", F.explode(half).alias("h")).select("fp", "h.side", "h.key")
    near = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    asked = stored.select(F.col("fp").alias("q"), "side", F.col("key").alias("near"), F.explode(near).alias("bit")).select("q", "side", F.col("near").bitwiseXOR(F.col("bit")).alias("key"))
    large = written(stored.groupBy("side", "key").count().where(F.col("count") > LARGE_BUCKET).select("side", "key"), f"{work_dir(nodes.sparkSession)}/large")
    close = (F.col("q") < F.col("fp")) & (F.bit_count(F.col("q").bitwiseXOR(F.col("fp"))) <= MAX_DISTANCE)
    # explode() hides from the optimizer how many rows are asked: without the hint it would broadcast 33 for each stored one
    usual = asked.hint("merge").join(stored.join(large, ["side", "key"], "left_anti"), ["side", "key"]).where(close).select("q", "fp")

    def by_byte(rows: DataFrame, fp: str) -> DataFrame:
        other = F.when(F.col("side") == 0, F.col(fp)).otherwise(F.shiftrightunsigned(fp, 32))
        cuts = F.array(*[F.struct(F.lit(k).alias("cut"), F.shiftrightunsigned(other, 8 * k).bitwiseAND(F.lit(255)).alias("byte")) for k in range(4)])
        return rows.join(large, ["side", "key"], "left_semi").withColumn("c", F.explode(cuts)).select("side", "key", fp, "c.cut", "c.byte")

    crowded = by_byte(asked, "q").hint("merge").join(by_byte(stored, "fp"), ["side", "key", "cut", "byte"]).where(close).select("q", "fp")
    return usual.union(crowded).distinct().toDF("a", "b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, fp, root, component_id per row of docs(doc_id, text).

    fp: the signed SimHash; null, empty and blank texts have 0, linked like any other. root: the least fingerprint that is reachable
    over links of at most 3 bits. component_id: the least doc_id among the rows with that root; null ids count only where a component has
    no other. Repeated rows and repeated ids are rows of their own. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    path = work_dir(spark)
    fps = written(fingerprints(docs), f"{path}/fps")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), f"{path}/nodes")
    roots = components(links(nodes.select("fp")), f"{path}/rounds").withColumnRenamed("node", "fp")
    named = nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    # most components are one fingerprint: only the others need the least id of a group
    linked = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(named.select("fp", "root").join(linked, "root"), f"{path}/named")
    return fps.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def drop_near_duplicates(docs: DataFrame, by_similarity: bool = False) -> DataFrame:
    """The rows of docs, with all their columns, of which one is left for each component, as keep_one() says.

    Components are those of near_duplicates(); by_similarity, those of texts that share 0.8 of their five-word shingles, for which
    fingerprints alone find too little (near_dedup). Null, empty and blank texts are one component; an empty table stays empty.
    """
    if by_similarity:
        from rankloom.llm import near_dedup

        return near_dedup.drop_near_duplicates(docs)
    return keep_one(docs, near_duplicates(docs))


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs of which one is left for each component of found(doc_id, text_key, root, component_id): that of its component_id.

    A component whose ids are all null keeps the row with the least text_key. Rows that repeat both the kept id and its text are left once.
    """
    path = work_dir(docs.sparkSession)
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("k"))
    keys = kept.select(F.col("k.doc_id").alias("__rl_id"), F.col("k.text_key").alias("__rl_key"))
    times = found.groupBy(F.col("doc_id").alias("__rl_id"), F.col("text_key").alias("__rl_key")).count().select("__rl_id", "__rl_key", (F.col("count") > 1).alias("__rl_many"))
    keys = written(keys.join(times, keys["__rl_id"].eqNullSafe(times["__rl_id"]) & (keys["__rl_key"] == times["__rl_key"])).select(keys["__rl_id"], keys["__rl_key"], "__rl_many"), f"{path}/kept")
    # the keys grow with the documents: they are never broadcast
    one = lambda many: docs.join(keys.where(F.col("__rl_many") == many).hint("merge"), docs["doc_id"].eqNullSafe(F.col("__rl_id")) & (F.xxhash64(docs["text"]) == F.col("__rl_key")), "left_semi")
    return one(False).union(one(True).dropDuplicates(["doc_id", "text"]))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
