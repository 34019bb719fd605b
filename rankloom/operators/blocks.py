"""Block-max ranking over packed postings.

Each task deals its documents into tiles of at most TILE, in the order of their lengths and ids. parts has a row for each tile, and for each term in a tile:

  tile, term (null: the tile itself), gaps, tfs, blocks array<struct<block, n, top>>, ids, lengths

A term's postings in a tile are sorted by the documents' places and cut into blocks of BLOCK places. A block says how many postings it has and their greatest
tf; gaps are the places' differences, from the block's first place on, so that each block can be read alone. As neighbours have nearly equal
lengths, the greatest tf and the shortest length of a block bound its scores closely, whatever the parameters are.

No term is a task or a file: a term that every document has is a row in every tile. To rank, the rows of the queries' terms are brought together by
tile, where a task takes all queries along. Of each query it scores the blocks with the highest bounds, which gives the k-th best score, then those
blocks alone whose bounds reach it; k rows of each query leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.stem import PLAIN

#: Documents of a tile and places of a block; postings at which a tile ends even if it has fewer documents.
TILE, BLOCK, TILE_TOKENS = 4096, 64, 1_000_000
#: Postings that a task looks at together; rows of query terms that one scan takes along, of some 50 bytes each.
WAVE, SCAN_TERMS = 1_000_000, 1_000_000

SCHEMA = "tile long, term string, gaps array<int>, tfs array<int>, blocks array<struct<block: int, n: int, top: int>>, ids array<string>, lengths array<int>"


def pack(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """parts of rows(doc_id string, tokens). Write or cache the result: the numbers of tiles are those of the tasks that make them."""
    return pack_counted(counted(rows), tile)


#: Tokens that a task counts together; words whose stems it remembers.
COUNTED, STEMS = 200_000, 50_000


def counted(rows: DataFrame, stemming: str = "none") -> DataFrame:
    """doc_id, length, terms, tfs of rows(doc_id string, tokens): a document's distinct tokens, stemmed as said, and how often each occurs. Nothing is shuffled."""

    def each(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, str] = {}

        def stem(word: str) -> str:
            if (found := known.get(word)) is None:
                if len(known) == STEMS:
                    known.clear()
                found = known[word] = PLAIN[stemming](word)
            return found

        for b in batches:
            for some in _slices(b, 1, COUNTED):
                lists = some.column(1)
                sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                words = lists.flatten().dictionary_encode()
                code, names = words.indices.to_numpy(), words.dictionary
                if stemming != "none":
                    stems = pa.array([stem(w) for w in names.to_pylist()], pa.string()).dictionary_encode()
                    code, names = stems.indices.to_numpy()[code], stems.dictionary
                key, tfs = np.unique(np.repeat(np.arange(len(sizes)), sizes) * max(len(names), 1) + code, return_counts=True)
                ends = np.append(0, np.cumsum(np.bincount(key // max(len(names), 1), minlength=len(sizes)))).astype(np.int32)
                terms = names.take(pa.array(key % max(len(names), 1)))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(ends), terms), pa.ListArray.from_arrays(pa.array(ends), pa.array(tfs.astype(np.int32)))], ["doc_id", "length", "terms", "tfs"])
        known.clear()
        _release()

    return rows.select("doc_id", "tokens").mapInArrow(each, "doc_id string, length long, terms array<string>, tfs array<int>")


def _release() -> None:
    """Gives back what Arrow and Python have freed: workers are kept for later tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc keeps what arrays had, else
        trim(0)


def _slices(b, column: int, most: int) -> Iterator:
    """Slices of a batch whose lists in a column have at most so many elements together; a row alone may have more."""
    sizes = np.cumsum(b.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < b.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most, "right")))
        yield b.slice(at, end - at)
        at = end


def pack_counted(rows: DataFrame, tile: int = TILE) -> DataFrame:
    """parts of rows(doc_id string, length, terms, tfs), as pack, of tokens that are counted already.

    A task packs what it has, in the order of lengths: nothing is shuffled, and no task gets all of the long documents. It holds one tile, as Arrow arrays.
    """
    dealt = rows.select("length", "doc_id", "terms", "tfs").sortWithinPartitions("length", "doc_id")

    def packed(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        number, held, docs, n = TaskContext.get().partitionId() << 24, [], 0, 0
        for b in batches:
            sizes = b.column(2).value_lengths().to_numpy().tolist()
            begin = 0
            for i, size in enumerate(sizes):
                if docs and (docs == tile or n + size > TILE_TOKENS):
                    yield _tile(number, [*held, b.slice(begin, i - begin)])
                    number, held, docs, n, begin = number + 1, [], 0, 0, i
                docs += 1
                n += size
            held.append(b.slice(begin))
        if docs:
            yield _tile(number, held)
        held.clear()
        _release()

    return dealt.mapInArrow(packed, SCHEMA)


def _lists(values, sizes: np.ndarray, first: int = 0):
    """A list array of values cut by sizes, after `first` nulls."""
    import pyarrow as pa

    ends = np.concatenate([np.zeros(first + 1, np.int32), np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(np.arange(first + len(sizes)) < first))


def _tile(number: int, batches: list):
    """The rows of a tile: its own, then its terms in order. batches(length, doc_id, terms, tfs) of its documents."""
    import pyarrow as pa
    import pyarrow.compute as pc

    batches = [b for b in batches if b.num_rows]
    column = lambda i: pa.concat_arrays([b.column(i) for b in batches])
    sizes = np.concatenate([b.column(2).value_lengths().to_numpy() for b in batches])
    words = pa.concat_arrays([b.column(2).flatten() for b in batches]).dictionary_encode()
    order = pc.sort_indices(words.dictionary)
    terms = words.dictionary.take(order)
    rank = np.empty(len(terms), np.int64)
    rank[order.to_numpy()] = np.arange(len(terms))
    # one number a posting: term, place, tf
    tf = np.concatenate([b.column(3).flatten().to_numpy() for b in batches]).astype(np.int64)
    places, tfs = max(len(sizes) - 1, 1).bit_length(), max(int(tf.max(initial=1)), 1).bit_length()
    key = (rank[words.indices.to_numpy()] << places + tfs) | (np.repeat(np.arange(len(sizes)), sizes) << tfs) | tf
    key.sort()
    code, place, tf = (key >> places + tfs).astype(np.int32), ((key >> tfs) & (1 << places) - 1).astype(np.int32), (key & (1 << tfs) - 1).astype(np.int32)
    del words, key
    block = place // BLOCK
    new = np.append(True, (code[1:] != code[:-1]) | (block[1:] != block[:-1])) if len(code) else np.empty(0, bool)
    first = np.flatnonzero(new)
    gaps = np.diff(place, prepend=0)
    gaps[new] = place[new] % BLOCK
    n = np.diff(np.append(first, len(code)))
    blocks = pa.StructArray.from_arrays([pa.array(block[first], pa.int32()), pa.array(n, pa.int32()), pa.array(np.maximum.reduceat(tf, first) if len(first) else tf)], ["block", "n", "top"])
    per_term, rows = np.bincount(code, minlength=len(terms)), 1 + len(terms)
    own = lambda values: pa.ListArray.from_arrays(pa.array(np.append(0, np.full(rows, len(values))).astype(np.int32)), values, mask=pa.array(np.arange(rows) > 0))
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(rows, number)), pa.concat_arrays([pa.nulls(1, pa.string()), terms]), _lists(pa.array(gaps, pa.int32()), per_term, 1), _lists(pa.array(tf), per_term, 1),
        _lists(blocks, np.bincount(code[first], minlength=len(terms)), 1), own(column(1)), own(column(0).cast(pa.int32())),
    ], ["tile", "term", "gaps", "tfs", "blocks", "ids", "lengths"])


def unpack(parts: DataFrame, *keep: str) -> DataFrame:
    """term, doc_id, tf, doc_length of parts, and the columns of parts to keep. Documents whose ids are null are left out."""
    own = parts.where("term is null").select(F.col("tile").alias("o_tile"), "ids", "lengths")
    rows = parts.where("term is not null").drop("ids", "lengths").join(own, F.col("tile") == F.col("o_tile"))
    # places: gaps added up within each block
    flat = F.aggregate("blocks", F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places")), lambda s, b: F.struct(
        (s["at"] + b["n"]).alias("at"), F.concat(s["places"], F.transform(F.sequence(F.lit(1), b["n"]), lambda i: b["block"] * BLOCK + F.aggregate(F.slice("gaps", s["at"] + 1, i), F.lit(0), lambda x, g: x + g))).alias("places")))["places"]
    pairs = rows.select(*keep, "term", "ids", "lengths", F.explode(F.arrays_zip(flat.alias("place"), F.col("tfs").alias("tf"))).alias("p"))
    return pairs.select(*keep, "term", F.get("ids", F.col("p.place")).alias("doc_id"), F.col("p.tf").cast("long").alias("tf"), F.get("lengths", F.col("p.place")).cast("long").alias("doc_length")).where("doc_id is not null")


class Wave:
    """Some whole tiles, with the rows of the terms that are asked for; terms: their codes."""

    def __init__(self, rows, terms):
        import pyarrow as pa
        import pyarrow.compute as pc

        own = pc.is_null(rows.column(1)).to_numpy(zero_copy_only=False)
        tile = np.cumsum(own) - 1
        heads, lists = rows.take(pa.array(np.flatnonzero(own))), rows.take(pa.array(np.flatnonzero(~own)))
        tile = tile[~own]
        self.ids = heads.column(5).flatten()
        sizes = pc.list_value_length(heads.column(5)).to_numpy()
        self.doc_at = np.cumsum(sizes) - sizes  # of each tile's first document among ids
        lengths = heads.column(6).flatten().to_numpy()
        per_tile = -(-TILE // BLOCK)
        self.places = per_tile * BLOCK
        self.length = np.zeros(len(sizes) * self.places)
        where = np.repeat(np.arange(len(sizes)) * self.places - self.doc_at, sizes) + np.arange(len(lengths))
        self.length[where] = lengths
        gone = pc.is_null(self.ids).to_numpy(zero_copy_only=False)
        self.gone = None
        if gone.any():
            self.gone = np.zeros(len(self.length), bool)
            self.gone[where] = gone
        self.shortest = self.length[::BLOCK]  # documents of a tile come by length
        blocks = lists.column(4)
        per_row = pc.list_value_length(blocks).to_numpy()
        flat = blocks.flatten()
        number, self.n, self.top = (flat.field(i).to_numpy() for i in range(3))
        self.gaps, self.tfs = lists.column(2).flatten().to_numpy(), lists.column(3).flatten().to_numpy()
        self.at = np.cumsum(self.n, dtype=np.int64) - self.n
        self.block = np.repeat(tile * per_tile, per_row) + number
        code = pc.index_in(lists.column(1), terms).to_numpy()
        code = np.repeat(code, per_row)
        self.order = np.argsort(code, kind="stable")
        self.begins = np.searchsorted(code[self.order], np.arange(len(terms) + 1))

    def asked(self, codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the blocks of these terms, weight of each)."""
        n = self.begins[codes + 1] - self.begins[codes]
        some = np.concatenate([self.order[self.begins[c] : self.begins[c + 1]] for c in codes.tolist()]) if len(codes) else np.empty(0, np.int64)
        return some, np.repeat(weights, n)

    def bounds(self, norm) -> np.ndarray:
        """The greatest share of a term's weight that a document of each block can have."""
        return self.top / (self.top + norm(self.shortest)[self.block])

    def scores(self, some: np.ndarray, weights: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all documents of these blocks, which are all blocks of the terms at their places."""
        n = self.n[some]
        start = np.cumsum(n) - n
        posting = np.repeat(self.at[some] - start, n) + np.arange(int(n.sum()))
        gap = self.gaps[posting]
        inside = np.cumsum(gap)
        inside = inside - np.repeat(inside[start] - gap[start], n)
        tf = self.tfs[posting]
        places, compact = np.unique(self.block[some], return_inverse=True)
        doc = np.repeat(self.block[some] * BLOCK, n) + inside
        got = np.bincount(np.repeat(compact * BLOCK, n) + inside, np.repeat(weights, n) * tf / (tf + norms[doc]), len(places) * BLOCK)
        hit = np.flatnonzero(got > 0)
        docs, score = places[hit // BLOCK] * BLOCK + hit % BLOCK, np.round(got[hit], 6)
        if self.gone is None:
            return docs, score
        there = ~self.gone[docs]
        return docs[there], score[there]

    def names(self, docs: np.ndarray):
        import pyarrow as pa

        return self.ids.take(pa.array(self.doc_at[docs // self.places] + docs % self.places))


class Best:
    """The k best rows of one query in a task, ties by id; with `ties`, also all rows that equal the last one. Rows below `least` are none of them."""

    def __init__(self, k: int, ties: bool, least: float = -np.inf):
        self.k, self.ties, self.score, self.ids, self.least = k, ties, np.empty(0), None, least

    def add(self, score: np.ndarray, names) -> None:
        """names(places) gives the ids of rows of score."""
        import pyarrow as pa
        import pyarrow.compute as pc

        places = np.flatnonzero(score >= self.least)
        score = score[places]
        if len(places) + len(self.score) >= self.k:
            every = np.append(self.score, score)
            self.least = np.partition(every, -self.k)[-self.k]
            pick = score >= self.least
            places, score = places[pick], score[pick]
        if not len(places):
            return
        ids = names(places)
        ids = ids if self.ids is None else pa.concat_arrays([self.ids, ids])
        score = np.append(self.score, score)
        pick = np.flatnonzero(score >= self.least)
        if len(pick) > self.k and not self.ties:
            above = pick[score[pick] > self.least]
            tied = pick[score[pick] == self.least]
            tied = tied[pc.sort_indices(ids.take(pa.array(tied))).to_numpy()]
            pick = np.append(above, tied[: self.k - len(above)])
        self.score, self.ids = score[pick], ids.take(pa.array(pick))


def _add(best: Best, wave: Wave, docs: np.ndarray, score: np.ndarray) -> None:
    best.add(score, lambda places: wave.names(docs[places]))


def search(wave: Wave, codes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, norms: np.ndarray, best: Best) -> tuple[int, int]:
    """Adds a wave's best rows of one query. (postings of its terms, postings that were read)"""
    some, w = wave.asked(codes, weights)
    if not len(some):
        return 0, 0
    total, block = int(wave.n[some].sum()), wave.block[some]
    most = np.bincount(block, w * bounds[some], len(wave.shortest))
    open_ = most > 0
    read = 0
    seeds = -(-2 * best.k // BLOCK)
    if best.least == -np.inf and open_.sum() > 2 * seeds:
        first = np.zeros(len(most), bool)
        first[np.argpartition(most, -seeds)[-seeds:]] = True
        pick = first[block]
        read += int(wave.n[some[pick]].sum())
        _add(best, wave, *wave.scores(some[pick], w[pick], norms))
        open_ &= ~first
    open_ &= most >= best.least - 1e-6  # scores are rounded
    pick = open_[block]
    if pick.any():
        read += int(wave.n[some[pick]].sum())
        _add(best, wave, *wave.scores(some[pick], w[pick], norms))
    return total, read


def _waves(batches: Iterator, terms, size: int) -> Iterator[Wave]:
    """Rows sorted by tile, a tile's own first, in waves of whole tiles."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            n += len(b.column(2).flatten())
        if n > size:
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            cut = int(np.flatnonzero(pc.is_null(rows.column(1)).to_numpy(zero_copy_only=False))[-1])
            if cut:
                yield Wave(rows.slice(0, cut), terms)
            held = [rows.slice(cut)]
            n = len(held[0].column(2).flatten())
            size = max(size, 2 * n)  # a tile alone may have more
    if held:
        yield Wave(pa.Table.from_batches(held).combine_chunks().to_batches()[0], terms)


def bm25(weighted: DataFrame, parts: DataFrame, average: float, settings: list[tuple[float, float]], k: int, ties: bool = False, counts: bool = False, wave: int = WAVE, scan: int = SCAN_TERMS) -> DataFrame:
    """setting, query_id, doc_id, score: of weighted(query_id, term, weight) a superset of each query's k best documents, k of each task at most.

    average: the mean length of a document. setting: the place of a (k1, b); weights are without the factor k1 + 1. A scan of parts serves some `scan` rows of query terms.
    counts: setting, query_id, postings, read instead, by task.
    """
    spark, average = weighted.sparkSession, average or 1.0
    kind = weighted.schema["query_id"].dataType.simpleString()
    schema = f"setting int, query_id {kind}, " + ("postings long, read long" if counts else "doc_id string, score double")
    weighted = weighted.select("query_id", "term", F.col("weight").cast("double").alias("weight"))
    few = weighted.limit(scan + 1).toArrow()
    turns = 1 if few.num_rows <= scan else -(-weighted.count() // scan)
    out = spark.createDataFrame([], schema)
    for turn in range(turns):
        rows = few if turns == 1 else weighted.where(F.pmod(F.xxhash64("query_id"), F.lit(turns)) == turn).toArrow()
        if rows.num_rows:
            sent = spark.sparkContext.broadcast(rows)
            terms = spark.createDataFrame(rows.select(["term"]).group_by("term").aggregate([]))
            asked = parts.join(F.broadcast(terms.withColumn("asked", F.lit(True))), "term", "left").where("term is null or asked").select(*parts.columns)
            near = asked.repartition("tile").sortWithinPartitions("tile", F.col("term").asc_nulls_first())
            out = out.union(near.mapInArrow(lambda b, s=sent: _ranked(b, s.value, average, settings, k, ties, counts, wave), schema))
    return out


def _ranked(batches: Iterator, rows, average: float, settings, k: int, ties: bool, counts: bool, size: int) -> Iterator:
    import pyarrow as pa
    import pyarrow.compute as pc

    rows = rows.combine_chunks()
    queries, terms = rows.column(0).unique(), rows.column(1).unique()
    query, code = (pc.index_in(rows.column(i), u).to_numpy() for i, u in enumerate((queries, terms)))
    order = np.argsort(query, kind="stable")
    ends = np.searchsorted(query[order], np.arange(len(queries) + 1))
    code, weight = code[order], rows.column(2).to_numpy()[order]
    best = [[Best(k, ties) for _ in range(len(queries))] for _ in settings]
    told = np.zeros((len(settings), len(queries), 2), np.int64)
    for w in _waves(batches, terms, size):
        for s, (k1, b) in enumerate(settings):
            norm = lambda length, k1=k1, b=b: k1 * (1 - b + b * length / average)
            bounds, norms = w.bounds(norm), norm(w.length)
            for q in range(len(queries)):
                some = slice(ends[q], ends[q + 1])
                told[s, q] += search(w, code[some], weight[some] * (k1 + 1), bounds, norms, best[s][q])
    _release()
    for s, each in enumerate(best):
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(queries), s), pa.int32()), queries, pa.array(told[s, :, 0]), pa.array(told[s, :, 1])], ["setting", "query_id", "postings", "read"])
            continue
        found = [(q, x) for q, x in enumerate(each) if x.ids is not None]
        if found:
            numbers = np.repeat([q for q, _ in found], [len(x.score) for _, x in found])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(numbers), s), pa.int32()), queries.take(pa.array(numbers)), pa.concat_arrays([x.ids for _, x in found]), pa.array(np.concatenate([x.score for _, x in found]))], ["setting", "query_id", "doc_id", "score"])
