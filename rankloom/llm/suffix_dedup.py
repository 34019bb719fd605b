"""Operator 13, suffix-array dedup by bucket-pointer refinement: bytes go that a run of LENGTH bytes covers which also starts earlier.

Suffixes are compared up to LENGTH bytes. Their buckets are refined in three steps, each on buckets that the step before left open:

1. Of each window of LENGTH bytes, the q-gram with the least identifier is its anchor: equal windows have equal anchors at equal places. Neighbouring
   windows with one anchor are a phrase, some 35 windows. The anchors' suffixes are dealt into q-gram buckets by a distributed sort; a bucket is refined
   by the identifiers of the q-grams at later (and earlier) offsets of its phrases, which say whether whole phrases are equal. Rows are then
   compared with their neighbours: of equal phrases the first stays, and buckets that hold one phrase are done.
2. The distinct phrases of a bucket that holds several are fetched, and sorted by bucket and place; a bucket of more than SPREAD is dealt over
   several tasks. Each window starts in the bucket of its q-gram and its
   distance to the anchor; buckets are refined by sorting on the identifiers at offset q, then 2q, and so on to LENGTH; pointers of one
   round are what the next one sorts by, and windows alone in a bucket leave.
3. Buckets that were dealt over several tasks are joined by 128 bits of identifiers of the first windows that each part of them found.

The order of step 1 holds the place of a row, so that a bucket that holds a third of all rows is cut by range and belongs to many tasks; only the two rows
at each end of a partition are settled with those of others. Identifiers are 64-bit hashes of q bytes; two phrases or windows are taken as
equal when two or more such hashes are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import table, work_dir, written

#: Bytes of a run that is deleted when it occurs again; bytes of a q-gram.
LENGTH, Q = 100, 32
#: Windows of a text that are looked at in one go; bytes of phrases that a task refines in one go; phrases of a bucket that are refined together.
STEP, CHUNK, SPREAD = 1 << 18, 4 << 20, 20_000
#: Buckets of over SPREAD phrases that are broadcast, of 16 bytes each.
LARGE_SENT = 500_000
#: What the sorted rows are found to be. HEAD is the first row of a partition, TAIL the one phrase of the bucket that ends it; MULTI: its bucket has several.
REPEAT, OPEN, HEAD, HEAD_MULTI, TAIL, END_MULTI = range(6)

_U = np.uint64
_M = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]
_LOW = _U((1 << 20) - 1)


def gram_ids(raw: bytes, q: int) -> np.ndarray:
    """Identifiers of the q-grams at all offsets, q >= 8: words of eight bytes, joined with the words at later offsets until they reach q."""
    n = len(raw) - 7
    if n + 8 <= q:
        return np.empty(0, _U)
    ids = np.empty(n, _U)
    for k in range(min(8, n)):
        ids[k::8] = np.frombuffer(raw, "<u8", len(range(k, n, 8)), k)
    have, turn = 8, 0
    while have < q:
        later = min(have, q - have)
        first = ids[:-later] * _M[turn % 6]
        first ^= first >> _U(29)
        first += ids[later:] * _M[(turn + 1) % 6]
        first ^= first >> _U(32)
        ids, have, turn = first, have + later, turn + 2
    ids = ids * _M[4]
    return ids ^ (ids >> _U(31))


def _joined(state: np.ndarray, ids: np.ndarray, lane: int) -> np.ndarray:
    state = (state ^ ids) * _M[lane]
    return state ^ (state >> _U(32))


def phrases(raw: bytes, length: int = LENGTH, q: int = Q, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q-gram identifier of the anchor, identifier of the phrase, at) of a text's phrases. at: first window << 16 | anchor - first << 8 | last - first."""
    total, reach = len(raw) - length + 1, length - q
    found: list[tuple] = []
    start = 0
    while start < total:
        stop = min(total, start + step)
        ids = gram_ids(raw[start : stop + length - 1], q)
        least, width = (ids & ~_LOW) | np.arange(len(ids), dtype=_U), 1
        while width < reach + 1:
            more = min(width, reach + 1 - width)
            least, width = np.minimum(least[:-more], least[more:]), width + more
        anchor = (least & _LOW).astype(np.int64)
        first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        last, anchor, following = np.append(first[1:], stop - start) - 1, anchor[first], total
        if stop < total:  # the last phrase may go on: it is where the next turn starts
            following = start + int(first[-1])
            first, last, anchor = first[:-1], last[:-1], anchor[:-1]
        whole = _joined(((anchor - first) << 8 | (last - first)).astype(_U), _M[5], 2)
        for k in range(0, 2 * reach + q, q):
            whole = _joined(whole, ids[np.minimum(first + k, last + reach)], k // q % 2)
        found.append((ids[anchor], whole, (first + start) << 16 | (anchor - first) << 8 | (last - first)))
        start = following
    return tuple(np.concatenate([f[k] for f in found]) if found else np.empty(0, (_U, _U, np.int64)[k]) for k in range(3))


def _changes(now: np.ndarray, before) -> np.ndarray:
    """Where a value differs from the one before it; before: the last of the previous batch, or None."""
    return np.append(True if before is None else now[:1] != before, now[1:] != now[:-1]) if len(now) else np.empty(0, bool)


def _neighbours(batches: Iterator) -> Iterator:
    """Of rows (b, k, doc_id, key, at) sorted by all: the repeats (REPEAT), the first rows of the phrases of buckets with several (OPEN), and what the ends
    of the partition have to settle. Rows equal to the one before are the same row given twice, and left out."""
    import pyarrow as pa
    import pyarrow.compute as pc
    from pyspark import TaskContext

    number = TaskContext.get().partitionId()
    last, held, head, several = None, None, True, False  # held: the first row of the bucket at hand, while it has one phrase

    def out(rows: pa.RecordBatch, kind) -> pa.RecordBatch:
        kinds = pa.array(kind if isinstance(kind, np.ndarray) else np.full(rows.num_rows, kind), pa.int32())
        return pa.RecordBatch.from_arrays([*rows.columns, kinds, pa.array(np.full(rows.num_rows, number), pa.int32())], [*rows.schema.names, "kind", "part"])

    for rows in batches:
        if not rows.num_rows:
            continue
        b, k, key, at = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3, 4))
        new_b = _changes(b, last and last[0])
        new_k = new_b | _changes(k, last and last[1])
        ids = rows.column(2)
        moved = np.append(last is None or last[4] != ids[0], ~pc.fill_null(pc.equal(ids[1:], ids[:-1]), False).to_numpy(zero_copy_only=False) & ~pc.and_(pc.is_null(ids[1:]), pc.is_null(ids[:-1])).to_numpy(zero_copy_only=False))
        again = ~(new_k | moved | _changes(key, last and last[2]) | _changes(at, last and last[3]))
        run = np.cumsum(new_b)  # 0: the bucket that the batch before ended in
        n_phrases = np.bincount(run, weights=new_k, minlength=run[-1] + 1).astype(int)
        many = n_phrases > 1
        many[0] = several or n_phrases[0] > 0 and last is not None
        kinds = np.where(~new_k & ~again, REPEAT, np.where(new_k & many[run], OPEN, -1))
        if held is not None and (many[0] or run[-1] > 0):
            if head:
                yield out(held, HEAD_MULTI if many[0] else HEAD)
            elif many[0]:
                yield out(held, OPEN)
            held, head = None, False
        if last is None:
            # the partition's first row is told apart, whatever its bucket is
            kinds[0] = -1
            if many[1] or run[-1] > 1:
                yield out(rows.slice(0, 1), HEAD_MULTI if many[1] else HEAD)
                head = False
            else:
                held = rows.slice(0, 1)
        pick = np.flatnonzero(kinds >= 0)
        if len(pick):
            yield out(rows.take(pa.array(pick)), kinds[pick])
        begun = np.flatnonzero(new_b)
        if len(begun) and not many[-1] and not (last is None and begun[-1] == 0):
            held, head = rows.slice(begun[-1], 1), False
        several = bool(many[-1])
        last = (b[-1], k[-1], key[-1], at[-1], ids[-1])
        end = rows.slice(rows.num_rows - 1, 1)
    if last is not None:
        if held is not None:
            yield out(held, HEAD if head else TAIL)
        if several:
            yield out(end, END_MULTI)


def _settled(edges: DataFrame) -> DataFrame:
    """The rows at the ends of partitions, two of each at most, as REPEAT or OPEN, or left out."""
    bucket, phrase = Window.partitionBy("b"), Window.partitionBy("b", "k")
    multi = F.max(F.col("kind").isin(HEAD_MULTI, END_MULTI)).over(bucket) | (F.min("k").over(bucket) != F.max("k").over(bucket))
    seen = F.min("part").over(phrase) < F.col("part")
    kind = F.when(F.col("kind").isin(HEAD, HEAD_MULTI) & seen, REPEAT).when((F.col("kind") != END_MULTI) & multi, OPEN)
    return edges.withColumn("kind", kind).where("kind is not null")


def refined(bodies: list[bytes], at: np.ndarray, bucket: np.ndarray, length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of phrases in the order of bucket and place: (phrase, number of the window) of all windows, which of them repeat an earlier one's bytes, and two identifiers."""
    sizes = np.array([len(x) for x in bodies])
    ids = gram_ids(b"".join(bodies), q)
    windows = (at & 255) + 1
    phrase = np.repeat(np.arange(len(bodies)), windows)
    number = np.arange(len(phrase)) - np.repeat(np.cumsum(windows) - windows, windows)
    start = np.repeat(np.cumsum(sizes) - sizes, windows) + number
    offsets = [0, *range(q, length - q, q), *([length - q] if length > q else [])]
    one, two = (np.full(len(start), _M[5 - lane]) for lane in (0, 1))
    for k in offsets:
        one, two = _joined(one, ids[start + k], 0), _joined(two, ids[start + k], 2)
    # bucket pointers: numbers of the buckets of equal bytes so far; windows alone in theirs leave
    alive, pointer = np.arange(len(start)), bucket[phrase] << 8 | ((at >> 8 & 255)[phrase] - number)
    for k in offsets:
        grams = ids[start[alive] + k]
        order = np.lexsort((grams, pointer))
        alive, grams, pointer = alive[order], grams[order], pointer[order]
        new = np.append(True, (grams[1:] != grams[:-1]) | (pointer[1:] != pointer[:-1])) if len(alive) else np.empty(0, bool)
        shared = ~new | np.append(~new[1:], False)
        alive, pointer, new = alive[shared], np.cumsum(new)[shared], new[shared]
    repeat = np.zeros(len(start), bool)
    if len(alive):
        repeat[alive[~new]] = True  # sorts are stable: the first of a bucket is the first in place
    return phrase, number, repeat, one, two


def _spans(docs: DataFrame, path: str, length: int, q: int, partitions: int, chunk: int, step: int, spread: int) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts(doc_id, id, key, text) dealt by (id, key); spans(id, key, span) with span = start << 16 | bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    # the order of rows is doc_id; a hash of the text tells rows apart that share one
    shared = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").take(1)
    texts = texts.withColumn("key", F.xxhash64("text") if shared else F.lit(0).cast("long")).withColumn("id", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))

    def anchored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            where, found, size = [], [], 0
            for i, raw in enumerate(b.column(2).to_pylist()):
                if raw and len(raw) >= length:
                    p = phrases(raw, length, q, step)
                    where.append(np.full(len(p[0]), i))
                    found.append(p)
                    size += len(p[0])
                if found and (size > 200_000 or i == b.num_rows - 1):
                    rows = pa.array(np.concatenate(where))
                    cols = [np.concatenate([f[k] for f in found]).view(np.int64) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), b.column(0).take(rows), b.column(1).take(rows), pa.array(cols[2])], ["b", "k", "doc_id", "key", "at"])
                    where, found, size = [], [], 0
            if found:
                rows = pa.array(np.concatenate(where))
                cols = [np.concatenate([f[k] for f in found]).view(np.int64) for k in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), b.column(0).take(rows), b.column(1).take(rows), pa.array(cols[2])], ["b", "k", "doc_id", "key", "at"])

    place = ["doc_id", "key", "at"]
    suffixes = texts.select("doc_id", "key", "text").mapInArrow(anchored, f"b long, k long, doc_id {kind}, key long, at long")
    suffixes = suffixes.repartitionByRange(partitions, "b", "k", *place).sortWithinPartitions("b", "k", *place)
    found = written(suffixes.mapInArrow(_neighbours, f"b long, k long, doc_id {kind}, key long, at long, kind int, part int"), f"{path}/found")
    found = found.where(F.col("kind") <= OPEN).drop("part").union(_settled(found.where(F.col("kind") > OPEN)).drop("part"))
    found = found.withColumn("id", F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")))
    at = F.col("at")
    whole = found.where(F.col("kind") == REPEAT).select("id", "key", (F.shiftright(at, 16) * 65536 + at.bitwiseAND(255) + length).alias("span"))
    several = found.where(F.col("kind") == OPEN).select("id", "key", "at", "b")
    # part: -1, or in buckets of very many phrases the one of its parts that a document's phrases belong to
    large = several.groupBy(F.col("b").alias("l_b")).agg(F.count("*").alias("n")).where(F.col("n") > spread).select("l_b", F.ceil(F.col("n") / spread).alias("parts"))
    large = written(large, f"{path}/large")
    if large.limit(LARGE_SENT + 1).count() <= LARGE_SENT:  # else a shuffled join, which adaptive execution splits
        large = F.broadcast(large)
    several = several.join(large, F.col("b") == F.col("l_b"), "left").withColumn("part", F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("id", "key"), "parts")).otherwise(-1).cast("long"))
    several = several.groupBy(F.col("id").alias("o_id"), F.col("key").alias("o_key")).agg(F.flatten(F.collect_list(F.array("at", "b", "part"))).alias("open"))
    texts = texts.select("doc_id", "id", "key", "text").repartition(partitions, "id", "key")

    def fetched(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                lists = part.column(3)
                sizes = np.diff(lists.offsets.to_numpy()) // 3
                flat = lists.flatten().to_numpy()
                at, bucket, share, rows = flat[::3], flat[1::3], flat[2::3], np.repeat(np.arange(len(sizes)), sizes)
                raws = part.column(2).to_pylist()
                bodies = [raws[i][a >> 16 : (a >> 16) + (a & 255) + length] for i, a in zip(rows.tolist(), at.tolist())]
                taken = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(share), part.column(0).take(taken), part.column(1).take(taken), pa.array(at), pa.array(bodies, pa.binary())], ["b", "part", "doc_id", "key", "at", "body"])

    bodies = texts.join(several, (F.col("id") == F.col("o_id")) & (F.col("key") == F.col("o_key"))).select("doc_id", "key", "text", "open")
    bodies = bodies.mapInArrow(fetched, f"b long, part long, doc_id {kind}, key long, at long, body binary")
    bodies = bodies.repartition(partitions, "b", "part").sortWithinPartitions("b", "part", *place)

    def compared(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(rows: pa.RecordBatch) -> pa.RecordBatch:
            b, share, at = (rows.column(i).to_numpy() for i in (0, 1, 4))
            phrase, number, repeat, one, two = refined(rows.column(5).to_pylist(), at, np.cumsum(_changes(b, None) | _changes(share, None)), length, q)
            first = at >> 16
            # runs of repeated windows of a phrase are one span
            r = np.flatnonzero(repeat)
            begins = _changes(r - np.arange(len(r)), None) | _changes(phrase[r], None)
            ends = np.append(begins[1:], True) if len(r) else begins
            begins, ends = r[begins], r[ends]
            # of a bucket in several parts, the first windows of each part are told apart by their bytes
            s = np.flatnonzero(~repeat & (share >= 0)[phrase])
            spans = np.append((first[phrase[begins]] + number[begins]) << 16 | (number[ends] - number[begins] + length), (first[phrase[s]] + number[s]) << 16 | length)
            taken = pa.array(np.append(phrase[begins], phrase[s]))
            # a span that is settled has identifiers of its own place, that no order rests on
            c1 = np.append(begins.astype(_U) * _M[0] ^ b[phrase[begins]].view(_U), one[s]).view(np.int64)
            c2 = np.append(np.zeros(len(begins), _U), two[s]).view(np.int64)
            done = np.append(np.ones(len(begins), bool), np.zeros(len(s), bool))
            return pa.RecordBatch.from_arrays([pa.array(c1), pa.array(c2), rows.column(2).take(taken), rows.column(3).take(taken), pa.array(spans), pa.array(done)], ["c1", "c2", "doc_id", "key", "span", "done"])

        held, size = [], 0
        for rows in batches:
            if rows.num_rows:
                held.append(rows)
                size += rows.column(5).nbytes
            if size > chunk:  # up to the last bucket, or part of one, that has ended
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                cut = int(np.flatnonzero(np.append(True, np.diff(rows.column(0).to_numpy()) | np.diff(rows.column(1).to_numpy())))[-1])
                if cut:
                    yield out(rows.slice(0, cut))
                held = [rows.slice(cut)]
                size = held[0].column(5).nbytes if cut else 0  # a bucket that alone is larger goes on to its end
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    def joined(batches: Iterator) -> Iterator:
        """Of spans sorted by identifiers and place, the settled ones and all but the first of a window."""
        import pyarrow as pa

        before: tuple = (None, None)
        for rows in batches:
            if rows.num_rows:
                c1, c2 = rows.column(0).to_numpy(), rows.column(1).to_numpy()
                done = rows.column(5).to_numpy(zero_copy_only=False)
                pick = pa.array(np.flatnonzero(done | ~(_changes(c1, before[0]) | _changes(c2, before[1]))))
                before = c1[-1], c2[-1]
                yield pa.RecordBatch.from_arrays([rows.column(2).take(pick), rows.column(3).take(pick), rows.column(4).take(pick)], ["doc_id", "key", "span"])

    parts = bodies.mapInArrow(compared, f"c1 long, c2 long, doc_id {kind}, key long, span long, done boolean")
    parts = parts.repartition(partitions, "c1", "c2").sortWithinPartitions("c1", "c2", "done", "doc_id", "key", "span")
    parts = parts.mapInArrow(joined, f"doc_id {kind}, key long, span long")
    parts = parts.select(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("")).alias("id"), "key", "span")
    return texts, whole.union(parts)


RUNS = "array<struct<start: long, end: long>>"


def _kept(raw: bytes, spans: np.ndarray) -> tuple[list[tuple[int, int]], list[bytes]]:
    """The maximal removed runs, and the pieces between them. spans: start << 16 | bytes, in any order."""
    spans = np.sort(spans)
    start = spans >> 16
    reach = np.maximum.accumulate(start + (spans & 65535))
    new = np.append(True, start[1:] > reach[:-1])
    runs = list(zip(start[new].tolist(), reach[np.append(new[1:], True)].tolist()))
    ends = [0, *(e for _, e in runs)]
    return runs, [raw[a:b] for a, b in zip(ends, [*(s for s, _ in runs), len(raw)])]


def _cut(docs: DataFrame, each, schema: str, length: int, q: int, partitions: int | None, chunk: int, step: int, spread: int) -> DataFrame:
    """A row per row of docs: doc_id, then the columns that each(raw text or None, runs, pieces) gives."""
    spark = docs.sparkSession
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    if not 8 <= q <= length or length - q > 255:
        raise ValueError("a q-gram has 8 bytes or more, and 255 fewer than a run at most")
    texts, spans = _spans(docs, work_dir(spark), length, q, partitions, chunk, step, spread)
    spans = spans.groupBy(F.col("id").alias("s_id"), F.col("key").alias("s_key")).agg(F.collect_list("span").alias("spans"))

    def cut(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = {"long": pa.int64(), "string": pa.string(), RUNS: pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))}
        names, types = zip(*((c.split(" ", 1)[0], kinds[c.split(" ", 1)[1]]) for c in schema.split(", ", schema.count(", ") if RUNS not in schema else 1)))
        for b in batches:
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                out = []
                for raw, found in zip(part.column(1).to_pylist(), part.column(2)):
                    out.append(each(raw, *(([], [raw or b""]) if not found.is_valid else _kept(raw, found.values.to_numpy()))))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = texts.join(spans, (F.col("id") == F.col("s_id")) & (F.col("key") == F.col("s_key")), "left").select("doc_id", "text", "spans")
    return rows.mapInArrow(cut, f"doc_id {kind}, {schema}")


def dedup_bytes(docs: DataFrame, length: int = LENGTH, q: int = Q, partitions: int | None = None, chunk: int = CHUNK, step: int = STEP, spread: int = SPREAD) -> DataFrame:
    """doc_id, text (what is left; bytes that are no UTF-8 any more are replaced), removed array<struct<start, end>> (bytes), per row of docs.

    Odd rows are as in summarise; a null text stays null.
    """
    each = lambda raw, runs, pieces: (None if raw is None else b"".join(pieces).decode("utf-8", "replace"), [{"start": s, "end": e} for s, e in runs])
    return _cut(docs, each, f"text string, removed {RUNS}", length, q, partitions, chunk, step, spread)


def summarise(docs: DataFrame, length: int = LENGTH, q: int = Q, partitions: int | None = None, chunk: int = CHUNK, step: int = STEP, spread: int = SPREAD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 per row of docs(doc_id, text).

    Null texts are empty; empty texts and those below `length` bytes lose nothing. Documents are in the order of doc_id (null first), those
    that share one in the order of a hash of their texts; rows that repeat both are one document given more than once and have the same result.
    An empty table gives an empty result; other columns are not looked at.
    """

    def each(raw, runs, pieces):
        h = hashlib.sha256()
        for p in pieces:
            h.update(p)
        return len(raw or b""), sum(e - s for s, e in runs), len(runs), h.hexdigest()

    return _cut(docs, each, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", length, q, partitions, chunk, step, spread)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
h AS (SELECT doc_id, text, hex(encode(text)) AS x, octet_length(encode(text)) AS n FROM d),
s AS (SELECT doc_id, text, x, unnest(range(n - {LENGTH - 1})) AS p FROM h WHERE n >= {LENGTH}),
w AS (SELECT doc_id, text, p, substr(x, 2 * p + 1, {2 * LENGTH}) AS body FROM s),
r AS (SELECT doc_id, text, p FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, text, p) AS k FROM w) WHERE k > 1),
a AS (SELECT doc_id, text, p, coalesce(p > lag(p) OVER o + {LENGTH}, true) AS new FROM r WINDOW o AS (PARTITION BY doc_id, text ORDER BY p)),
g AS (SELECT doc_id, text, p, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, text ORDER BY p) AS run FROM a),
m AS (SELECT doc_id, text, run, min(p) AS b, max(p) + {LENGTH} AS e FROM g GROUP BY ALL),
c AS (SELECT doc_id, text, run, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id, text ORDER BY run), 0) AS f FROM m),
k AS (SELECT doc_id, text, h.n, sum(e - b) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * f + 1, 2 * (b - f)), '' ORDER BY run) || substr(any_value(x), 2 * max(e) + 1) AS kept
  FROM c JOIN h USING (doc_id, text) GROUP BY ALL)
SELECT o.doc_id, CAST(octet_length(encode(coalesce(o.text, ''))) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN kept IS NULL THEN encode(coalesce(o.text, '')) ELSE unhex(kept) END) AS kept_sha256
FROM documents o LEFT JOIN k ON o.doc_id IS NOT DISTINCT FROM k.doc_id AND o.text IS NOT DISTINCT FROM k.text
"""
