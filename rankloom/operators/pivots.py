"""Exact dense search with groups of vectors that are skipped.

A bounded sample of the vectors are pivots; each vector belongs to the nearest. Vectors are sorted by pivot and distance to it and packed in chunks, so that a
chunk is a shell: all its vectors are between `low` and `high` from its pivot. A query that is further from the pivot than `high`, or nearer than
`low`, is at least the difference from each of them, by the triangle inequality, which bounds their inner products with it. A task takes
some queries along, whose best rows are all that it keeps: first each query's most promising chunks, then those that can still reach its k-th best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankloom.operators.blocks import Best
from rankloom.sources.folders import stored

#: Vectors that are drawn as pivots; vectors of a chunk; chunks that a task looks at together; queries x k that one scan takes along.
PIVOTS, CHUNK, WAVE, CELLS = 256, 256, 64, 1_000_000
#: k from which each query's floor is found first: k rows of each query and task would be many times the result.
FLOORS = 500


def _matrix(column, size: int | None = None) -> np.ndarray:
    """The rows of a list array as a matrix; ValueError if they are of unlike lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if size is None:
        size = len(flat) // max(len(column), 1)
    lengths = np.diff(column.offsets.to_numpy())
    if (lengths != size).any():
        raise ValueError("a vector is longer or shorter than the others")
    return flat.reshape(len(column), size)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of a and of b."""
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T), 0))


def pack(vectors: DataFrame, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """pivot, low, high, norm (the greatest), center (the pivot), ids, vectors (one after the other) per chunk of vectors(doc_id, vector).

    Vectors of unlike lengths are an error. Write or cache the result if it serves several searches.
    """
    spark = vectors.sparkSession
    vectors = vectors.select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    drawn = vectors.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pivots).toArrow()
    kind = vectors.schema["doc_id"].dataType.simpleString()
    schema = f"pivot int, low double, high double, norm double, center array<double>, ids array<{kind}>, vectors array<double>"
    if not drawn.num_rows:
        return spark.createDataFrame([], schema)
    sent = spark.sparkContext.broadcast(_matrix(drawn.combine_chunks().column(1).combine_chunks()))

    def assigned(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 1024):
                some = b.slice(k, 1024)
                d = _distances(_matrix(some.column(1), sent.value.shape[1]), sent.value)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int32()), pa.array(d[np.arange(len(near)), near]), *some.columns], ["pivot", "distance", "doc_id", "vector"])

    def packed(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = None

        def out(rows):
            v = _matrix(rows.column(3))
            pivot, d = rows.column(0)[0].as_py(), rows.column(1).to_numpy()
            cols = [[pivot], [d[0]], [d[-1]], [float(np.sqrt((v * v).sum(axis=1).max()))], [sent.value[pivot]]]
            ids = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows.column(2))
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.float64())))]
            return pa.RecordBatch.from_arrays([*arrays, ids, pa.array([v.ravel()], pa.list_(pa.float64()))], ["pivot", "low", "high", "norm", "center", "ids", "vectors"])

        for b in batches:
            if not b.num_rows:
                continue
            rows = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
            pivot = rows.column(0).to_numpy()
            ends = np.append(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1, len(pivot))
            at = 0
            for e in ends.tolist():
                while e - at >= chunk or at < e < len(pivot):
                    n = min(chunk, e - at)
                    yield out(rows.slice(at, n))
                    at += n
            held = rows.slice(at) if at < len(pivot) else None
        if held is not None:
            yield out(held)

    dealt = vectors.mapInArrow(assigned, f"pivot int, distance double, doc_id {kind}, vector array<double>").repartitionByRange("pivot", "distance", "doc_id")
    return dealt.sortWithinPartitions("pivot", "distance", "doc_id").mapInArrow(packed, schema)


def search(queries: DataFrame, chunks: DataFrame, k: int = 100, counts: bool = False, cells: int = CELLS) -> DataFrame:
    """query_id, doc_id, score: a superset of the k best of each query(query_id, vector), by inner product rounded to 6 places, k of each task at most.

    A scan of the chunks serves cells / k queries, so that what a task keeps does not grow with queries or k. counts: vectors, multiplied instead, by
    task: how many products of a query and a vector there are, and how many were made. From k = FLOORS on, a first pass finds a score that k rows of each
    query reach, of all tasks together, and tasks give the rows alone that reach it.
    """
    kind, own = chunks.schema["ids"].dataType.elementType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    schema = "vectors long, multiplied long" if counts else f"query_id {own}, doc_id {kind}, score double"
    known = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("floor"))
    if k >= FLOORS and not counts:
        known = known.drop("floor").join(floors(known, chunks, k, cells), "query_id", "left")
    return _scans(known, chunks.select("low", "high", "norm", "center", "ids", "vectors"), max(1, cells // k), schema, lambda b, sent: _searched(b, *sent, k, counts))


def _scans(known: DataFrame, chunks: DataFrame, scan: int, schema: str, each) -> DataFrame:
    """each(batches, (ids, vectors and floors of some `scan` queries)) of the chunks, for all of known(query_id, vector, floor)."""
    spark = known.sparkSession
    few = known.limit(scan + 1).toArrow()
    turns = 1 if few.num_rows <= scan else -(-known.count() // scan)
    out = spark.createDataFrame([], schema)
    for turn in range(turns):
        rows = few if turns == 1 else known.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).toArrow()
        if rows.num_rows:
            rows = rows.combine_chunks()
            floor = rows.column(2).combine_chunks().fill_null(-np.inf).to_numpy()
            sent = spark.sparkContext.broadcast((rows.column(0).combine_chunks(), _matrix(rows.column(1).combine_chunks()), floor))
            out = out.union(chunks.mapInArrow(lambda b, s=sent: each(b, s.value), schema))
    return out


def floors(known: DataFrame, chunks: DataFrame, k: int, cells: int = CELLS) -> DataFrame:
    """query_id, floor: a score that k rows of the query or more reach; queries with fewer rows have none. Written, as each scan of a search reads it.

    A task tells a query's scores at some of its ranks, and how many rows have it or more that the score told before does not stand for. The rows that reach the
    floor are k and at most some half more.
    """
    own = known.schema["query_id"].dataType.simpleString()
    told = _scans(known, chunks.select("vectors"), max(1, cells // k), f"query_id {own}, score double, n long", lambda b, sent: _told(b, sent[0], sent[1], k))
    reached = told.withColumn("reached", F.sum("n").over(Window.partitionBy("query_id").orderBy(F.desc("score"))))
    # a little less for rounding, and for products that are made in another order
    return stored(reached.where(F.col("reached") >= k).groupBy("query_id").agg((F.max("score") - 2e-6).alias("floor")))


def _told(batches: Iterator, names, q: np.ndarray, k: int) -> Iterator:
    import pyarrow as pa

    best = np.full((len(q), k), -np.inf)
    for b in batches:
        vectors = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, q.shape[1])
        for at in range(0, len(vectors), WAVE * CHUNK):
            some = vectors[at : at + WAVE * CHUNK]
            step = max(1, CELLS // (len(some) + k))
            for i in range(0, len(q), step):
                every = np.concatenate([best[i : i + step], q[i : i + step] @ some.T], axis=1)
                best[i : i + step] = np.partition(every, -k, axis=1)[:, -k:]
    best = -np.sort(-best, axis=1)
    ranks = np.unique(np.append(np.minimum((1.5 ** np.arange(64)).astype(np.int64), k), k))
    scores, n = best[:, ranks - 1], np.diff(ranks, prepend=0)
    query, place = np.nonzero(scores > -np.inf)
    if len(query):
        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(scores[query, place]), pa.array(n[place])], ["query_id", "score", "n"])


def _searched(batches: Iterator, names, q: np.ndarray, floor: np.ndarray, k: int, counts: bool) -> Iterator:
    import pyarrow as pa

    best = [Best(k, False, x) for x in floor.tolist()]
    norms, told = np.sqrt((q * q).sum(axis=1)), [0, 0]
    for b in batches:
        for at in range(0, b.num_rows, WAVE):
            _wave(b.slice(at, WAVE), q, norms, best, k, told)
    if counts:
        yield pa.RecordBatch.from_arrays([pa.array([told[0]]), pa.array([told[1]])], ["vectors", "multiplied"])
        return
    found = [(i, x) for i, x in enumerate(best) if x.ids is not None]
    if found:
        numbers = np.repeat([i for i, _ in found], [len(x.score) for _, x in found])
        yield pa.RecordBatch.from_arrays([names.take(pa.array(numbers)), pa.concat_arrays([x.ids for _, x in found]), pa.array(np.concatenate([x.score for _, x in found]))], ["query_id", "doc_id", "score"])


def _wave(rows, q: np.ndarray, norms: np.ndarray, best: list[Best], k: int, told: list[int]) -> None:
    low, high, norm = (rows.column(i).to_numpy() for i in range(3))
    centers = _matrix(rows.column(3))
    if centers.shape[1] != q.shape[1]:
        raise ValueError("the vectors are longer or shorter than the queries")
    lists = [rows.column(4).slice(i, 1).flatten() for i in range(rows.num_rows)]
    sizes = np.array([len(x) for x in lists])
    away = _distances(q, centers)
    apart = np.maximum(0, np.maximum(away - high, low - away))
    # half the difference of squares, and Cauchy-Schwarz around the pivot; a little more for rounding
    most = np.minimum((norms[:, None] ** 2 + norm**2 - apart**2) / 2, q @ centers.T + norms[:, None] * high) + 2e-6
    told[0] += len(q) * int(sizes.sum())
    least = np.array([x.least for x in best])
    # the first chunks of queries without k rows yet: the most promising ones that have so many
    order = np.argsort(-most, axis=1)
    behind = np.cumsum(sizes[order], axis=1) - sizes[order]
    first = np.zeros(most.shape, bool)
    np.put_along_axis(first, order, (behind < k) & (least == -np.inf)[:, None], axis=1)
    for turn in (0, 1):
        if turn:
            least = np.array([x.least for x in best])
        for c in range(rows.num_rows):
            some = np.flatnonzero(first[:, c] if turn == 0 else ~first[:, c] & (most[:, c] >= least))
            if len(some):
                vectors = rows.column(5).slice(c, 1).flatten().to_numpy().reshape(sizes[c], q.shape[1])
                score = np.round(q[some] @ vectors.T, 6) + 0.0
                told[1] += score.size
                hit = (score >= np.array([best[i].least for i in some])[:, None]).any(axis=1)
                for i, s in zip(some[hit].tolist(), score[hit]):
                    best[i].add(s, lambda places, ids=lists[c]: _taken(ids, places))


def _taken(ids, places: np.ndarray):
    import pyarrow as pa

    return ids.take(pa.array(places))
