"""Operator 1 for a similarity of word shingles: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more are linked.

The first candidates are those of operator 1: SimHash fingerprints, here of the sets, that the multi-index finds within its distance. At 0.8
two fingerprints differ by some ten bits, beyond the Hamming balls that can be looked up, so further candidates come from MinHash bands:
BANDS keys of ROWS least hashes each. Two texts of similarity 0.8 share none of them with a probability of (1 - 0.8^5)^25 = 0.00005, less
the more alike they are. Every candidate pair that can change a component is compared by its exact sets.

Only components count, so no bucket is compared all with all: first each member with the least of its bucket; what that links is one
component. The texts of buckets that still hold several components are then searched exactly: of two sets of similarity 0.8, the
rarest fifth of the larger one's shingles and the rarest ninth of the other's, in one common order, have a shingle in common (the prefix filter of
Chaudhuri et al., 2006, and its shorter prefix for the smaller set, of Xiao et al., 2008); only sets of near sizes are put together. Pages of one template that
are not similar have a ninth of their shingles to themselves, and meet nobody there; copies that were edited apart meet few others. Those that
meet, in different components, and whose places in the order leave enough to share, are held against a bound that no similar pair fails: each set has a sketch of CELLS bits, the parity of its shingles in each cell of
the hash space, and the bits in which two sketches differ are at most the shingles that the sets do not share. What is left is compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import components, work_dir, written
from rankloom.llm.simhash import _LOWER, keep_one
from rankloom.llm.simhash import links as fingerprint_links

SEED = 42
SHINGLE = 5
#: Similarity from which on two texts are linked, as a fraction: 4 / 5.
SIMILAR = (4, 5)
BANDS, ROWS = 25, 5
#: Bits of the parity sketch; long sets fill it up, and then fewer pairs are ruled out.
CELLS = 1024
#: Sizes of a class of sets, from the least to the next class's.
SIZE_STEP = 1.03


def shingles(text: bytes | None) -> frozenset[bytes]:
    """A text's runs of SHINGLE words in ASCII lower case; a shorter text is one, a text without words none."""
    words = (text or b"").translate(_LOWER).split()
    return frozenset(b" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))) if words else frozenset()


def similar(a: frozenset, b: frozenset) -> bool:
    """Whether the Jaccard similarity is SIMILAR or more; two empty sets are equal."""
    both = len(a & b)
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _salts():
    import numpy as np

    r = np.random.default_rng(SEED)
    return r.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64), r.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(text: bytes | None, salts=None) -> tuple[int, list[int]]:
    """(the signed SimHash of a text's shingles, the signed MinHash keys under which it is looked up); texts without words share theirs."""
    import numpy as np
    import xxhash

    found = shingles(text)
    if not found:
        return 0, [0]
    xor, odd = _salts() if salts is None else salts
    h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found))
    least, ones = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64), np.zeros(64, np.int64)
    with np.errstate(over="ignore"):
        for k in range(0, len(h), 4096):
            least = np.minimum(least, ((h[k : k + 4096] ^ xor) * odd).min(1))
            ones += np.unpackbits(h[k : k + 4096].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    fp = int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)
    return fp, [int.from_bytes(xxhash.xxh64_digest(row.tobytes(), band), "big", signed=True) for band, row in enumerate(least.reshape(BANDS, ROWS))]


def _keys(batches: Iterator) -> Iterator:
    import pyarrow as pa

    salts = _salts()
    for batch in batches:
        *ids, text = batch.columns
        texts = text.cast(pa.binary())
        rows = [sketch(texts[i].as_py(), salts) for i in range(len(texts))]
        cols = [pa.array([fp for fp, _ in rows], pa.int64()), pa.array([keys for _, keys in rows], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*ids, *cols], [*batch.schema.names[:-1], "fp", "keys"])


def parities(h) -> list[int]:
    """The sketch, as signed words, of an array of 64-bit hashes: for each cell whether an odd number of hashes lies in it."""
    import numpy as np

    odd = np.bincount((h >> np.uint64(65 - CELLS.bit_length())).astype(np.int64), minlength=CELLS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64).tolist()


def _hashed(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    for batch in batches:
        *keys, text = batch.columns
        rows = [np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles(text[i].cast(pa.binary()).as_py())], np.uint64) for i in range(batch.num_rows)]
        lists = [pa.array(x, pa.list_(pa.int64())) for x in ([r.view(np.int64) for r in rows], [parities(r) for r in rows])]
        yield pa.RecordBatch.from_arrays([*keys, *lists], [*batch.schema.names[:-1], "hs", "sketch"])


def prefixes(nodes: DataFrame, texts: DataFrame, path: str) -> DataFrame:
    """h, place, node, root, size, sketch: the shingles in which a node(node, root) can meet another one that is similar; size is that of its whole
    set, place the shingle's in its order, from 0.

    Sets are ordered by rarity among the nodes, then by hash. Two sets of similarity 4 / 5 share 4 / 5 of the larger one's shingles at
    least, so that their first common shingle is among the first n - ceil(4 n / 5) + 1 of each. Shingles that no other node has are left out after that.
    """
    texts = texts.select(F.xxhash64("text").alias("node"), F.col("text").cast("string").alias("t")).join(nodes.select("node").hint("merge"), "node", "left_semi")
    texts = texts.groupBy("node").agg(F.first("t").alias("t")).join(nodes.hint("merge"), "node").select("node", "root", "t")
    sets = written(texts.mapInArrow(_hashed, "node long, root long, hs array<long>, sketch array<long>"), f"{path}/sets")
    flat = sets.select("node", F.explode("hs").alias("h"))
    often = flat.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    flat = flat.join(often.hint("merge"), "h", "left").select("node", F.struct(F.coalesce("df", F.lit(1)).alias("df"), "h").alias("x"))
    size = F.size("hs").cast("long")
    order = flat.groupBy("node").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    first = sets.select("node", "root", "sketch", size.alias("size"), (size - F.ceil(size * F.lit(SIMILAR[0]) / F.lit(SIMILAR[1])) + 1).cast("int").alias("k")).join(order.hint("merge"), "node")
    return first.select("node", "root", "size", "sketch", F.posexplode(F.slice("xs", F.lit(1), F.col("k"))).alias("place", "x")).where("x.df > 1").select("x.h", "place", "node", "root", "size", "sketch")


def meetings(met: DataFrame) -> DataFrame:
    """All rows of met(h, place, node, root, size, sketch) put together with those of no larger sets, of similar size, in their shorter prefix: columns
    of the smaller set end in _b. Of a pair of similar sets there is a row for their first common shingle, which may_meet() keeps.

    A set shares (4 / 9) (n + m) shingles with one of m >= n that is similar, 8 / 9 of its own at least: its first common shingle is among the first
    n - ceil(8 n / 9) + 1. A set of n is put together with classes of sizes from 4 / 5 of n to n, at each place with those alone whose least size leaves
    enough shingles to share from there on.
    """
    num, den = SIMILAR
    log = math.log(SIZE_STEP)
    group = lambda size: F.floor(F.log(size) / F.lit(log)).cast("int")
    least = F.ceil(F.col("size") * num / den)
    larger = met.withColumn("class", F.explode(F.sequence(group(least), group(F.col("size")))))
    smallest = F.greatest(least, F.floor(F.pow(F.lit(SIZE_STEP), "class")) - 1)
    larger = larger.where((F.col("size") - F.col("place")) * (num + den) >= num * (F.col("size") + smallest))
    short = F.col("size") - F.ceil(F.col("size") * (2 * num) / (num + den)) + 1
    smaller = met.where(F.col("place") < short).select("h", group(F.col("size")).alias("class"), *[F.col(c).alias(f"{c}_b") for c in ("place", "node", "root", "size", "sketch")])
    return larger.join(smaller.hint("merge"), ["h", "class"])


def may_meet() -> Column:
    """Of meetings(), those of different components, once a pair, whose sizes and places leave as many shingles to share as similar sets do."""
    num, den = SIMILAR
    once = (F.col("size") > F.col("size_b")) | (F.col("size") == F.col("size_b")) & (F.col("node") > F.col("node_b"))
    left = F.least(F.col("size") - F.col("place"), F.col("size_b") - F.col("place_b"))
    return once & (F.col("root") != F.col("root_b")) & (F.col("size_b") * den >= F.col("size") * num) & (left * (num + den) >= num * (F.col("size") + F.col("size_b")))


def may_be_similar(a: str, b: str, size_a: str, size_b: str) -> Column:
    """False only for two sets, given by sketch and size, that are not similar: (S - d) / (S + d) is their similarity, S the sum of their
    sizes, d the number of shingles not shared, of which the sketches show the least."""
    apart = reduce(Column.__add__, [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(CELLS // 64)])
    return (F.col(size_a) + F.col(size_b)) * (SIMILAR[1] - SIMILAR[0]) >= apart * (SIMILAR[1] + SIMILAR[0])


def _similar(batches: Iterator) -> Iterator:
    import pyarrow as pa

    known, last = frozenset(), None
    for batch in batches:
        a, b, left, right = batch.columns
        keep = []
        for i, key in enumerate(a.to_pylist()):
            if key != last:
                known, last = shingles(left[i].cast(pa.binary()).as_py()), key
            keep.append(similar(known, shingles(right[i].cast(pa.binary()).as_py())))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])


def verified(pairs: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """The pairs (a, b) of text keys whose texts are similar."""
    pairs = written(pairs, f"{path}/candidates")
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
    # texts and pairs grow with the documents: they are never broadcast
    texts = docs.select(F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("t")).join(wanted.hint("merge"), "key", "left_semi")
    texts = written(texts.groupBy("key").agg(F.first("t").alias("t")), f"{path}/texts")
    left = texts.select(F.col("key").alias("a"), F.col("t").alias("left"))
    right = texts.select(F.col("key").alias("b"), F.col("t").alias("right"))
    joined = pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "left", "right")
    return written(joined.mapInArrow(_similar, "a long, b long"), f"{path}/similar")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, root, component_id per row of docs(doc_id, text).

    root: the least text key that is reachable over similar texts. component_id: the least doc_id among the rows with that root; null ids
    count only where a component has no other. Null, empty and blank texts are one component. Repeated rows and ids are rows of their own.
    """
    spark = docs.sparkSession
    path = work_dir(spark)
    kind = docs.schema["doc_id"].dataType.simpleString()
    named = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.col("text").cast("string").alias("text"))
    rows = written(named.mapInArrow(_keys, f"doc_id {kind}, text_key long, fp long, keys array<long>"), f"{path}/keys")
    nodes = written(rows.groupBy("text_key").agg(F.min("doc_id").alias("least"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), f"{path}/nodes")
    members = nodes.select(F.col("text_key").alias("node"), F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last")).where("first < last").select("key", "first")
    live = written(members.join(shared.hint("merge"), "key"), f"{path}/live")

    # texts with one fingerprint are a star, fingerprints that lie near are linked by the first text of each
    heads = written(nodes.groupBy("fp").agg(F.min("text_key").alias("head")), f"{path}/heads")
    same = nodes.select("fp", "text_key").join(heads.hint("merge"), "fp").where("text_key <> head").select(F.col("head").alias("a"), F.col("text_key").alias("b"))
    near = fingerprint_links(heads.select("fp")).toDF("fp", "q").join(heads.hint("merge"), "fp").select("q", F.col("head").alias("x"))
    near = near.join(heads.withColumnsRenamed({"fp": "q", "head": "y"}).hint("merge"), "q").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    banded = live.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    stars = verified(banded.union(same).union(near).distinct(), docs, f"{path}/stars")
    roots = components(stars, f"{path}/stars/rounds")
    live = written(live.select("key", "node").join(roots.hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node")), f"{path}/rooted")
    mixed = live.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    open_ = written(live.join(mixed.hint("merge"), "key", "left_semi"), f"{path}/open")
    met = written(prefixes(open_.select("node", "root").distinct(), docs, path), f"{path}/prefixes")
    mixed = met.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("h")
    met = written(met.join(mixed.hint("merge"), "h", "left_semi"), f"{path}/met")
    across = meetings(met).where(may_meet() & may_be_similar("sketch", "sketch_b", "size", "size_b"))
    across = across.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()
    links = stars.union(verified(across, docs, f"{path}/across"))

    roots = components(links, f"{path}/rounds").withColumnRenamed("node", "text_key")
    rooted = nodes.select("text_key", "least").join(roots.hint("merge"), "text_key", "left").withColumn("root", F.coalesce("root", "text_key"))
    linked = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = written(rooted.select("text_key", "root").join(linked.hint("merge"), "root"), f"{path}/named")
    return rows.select("doc_id", "text_key").join(rooted.hint("merge"), "text_key").select("doc_id", "text_key", "root", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which one is left for each component, as keep_one() says."""
    return keep_one(docs, near_duplicates(docs))
