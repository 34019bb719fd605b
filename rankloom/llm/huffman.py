"""Operator 6, token ids in a binary format: canonical length-limited Huffman code, independent blocks, bit-offset checkpoints.

The documents are tokenized once, into a table of raw ids; their global counts give one code for the corpus. The ids are coded where they
are, so that only coded bytes are shuffled into ascending doc_id order. A file row is one chunk: an independent block
with its documents' lengths, the bits of all their ids, and the bit offset of every STRIDE-th id. Chunks are kept in Parquet, whose
commit protocol a lost task can't break, beside a one-row table with the code lengths. Decoding looks up TABLE bits at a time, for all
checkpoints of a chunk at once.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import table, work_dir, written

#: End of document; ids between checkpoints; longest code at least (more if the vocabulary needs it); coded bytes in a chunk, about.
END_ID, STRIDE, MAX_BITS, CHUNK_BYTES = 1, 256, 16, 1 << 19
#: Distinct words whose ids a worker keeps, in each of two generations (some 160 MB each).
KNOWN_WORDS = 1_000_000
MAGIC = b"RLHC0001"
_SEPARATORS = re.compile("[\x1c-\x1f]").search

FILES = "part int, chunk int, doc_ids array<long>, n_docs int, n_ids long, block binary"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# --- the code ---


def code_lengths(counts, max_bits: int = MAX_BITS):
    """Code lengths, by package-merge, of ids with these counts; 0 for ids that do not occur. One id alone gets length 1.

    max_bits grows to what so many ids need at least.
    """
    import numpy as np

    counts = np.asarray(counts, np.int64)
    ids = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(ids) < 2:
        lengths[ids] = 1
        return lengths
    bits = max(max_bits, int(len(ids) - 1).bit_length())
    ids = ids[np.argsort(counts[ids], kind="stable")]
    weights = counts[ids]
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(bits):
        merged = np.concatenate([weights, packages])
        leaf = np.concatenate([np.ones(len(weights), bool), np.zeros(len(packages), bool)])
        order = np.argsort(merged, kind="stable")
        merged, leaf = merged[order], leaf[order]
        levels.append(leaf)
        even = len(merged) // 2 * 2
        packages = merged[:even:2] + merged[1:even:2]
    take = 2 * len(ids) - 2
    out = np.zeros(len(ids), np.int64)
    for leaf in reversed(levels):
        leaves = int(leaf[:take].sum())
        out[:leaves] += 1
        take = 2 * (take - leaves)
    lengths[ids] = out
    return lengths


class Code:
    """A canonical code: of equal lengths, the smaller id has the smaller code."""

    def __init__(self, lengths):
        import numpy as np

        self.lengths = np.asarray(lengths, np.uint8)
        self.max = int(self.lengths.max(initial=1))
        self.codes = np.zeros(len(self.lengths), np.uint32)
        used = np.flatnonzero(self.lengths)
        order = used[np.argsort(self.lengths[used], kind="stable")]
        n = self.lengths[order].astype(np.int64)
        # the first bits of each code, as a share of the code space of 2^max
        space = np.int64(1) << (self.max - n)
        at = np.cumsum(space) - space
        self.codes[order] = at >> (self.max - n)
        self.symbol = np.repeat(order, space).astype(np.uint32)
        self.symbol = np.concatenate([self.symbol, np.zeros((1 << self.max) - len(self.symbol), np.uint32)])
        self.bits = self.lengths[self.symbol].astype(np.int64)

    def encode(self, ids, ends):
        """(bytes, their end offsets, checkpoints' bit offsets in their document, number of them up to each document's end).

        ids: of all documents, in one array; `ends`: the number of ids up to each document's end. Each document begins at a byte. Its
        checkpoints are its first id and every STRIDE-th after that.
        """
        import numpy as np

        n = self.lengths[ids].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(n)))
        bounds = np.concatenate(([0], ends)).astype(np.int64)
        have = np.diff(bounds)
        size = (upto[bounds[1:]] - upto[bounds[:-1]] + 7) // 8
        after = np.cumsum(size)
        own = upto[:-1] - np.repeat(upto[bounds[:-1]], have)
        marked = np.flatnonzero((np.arange(len(ids)) - np.repeat(bounds[:-1], have)) % STRIDE == 0)
        begin = own + np.repeat(8 * (after - size), have)
        # a code of up to 24 bits lies in 4 bytes
        word = self.codes[ids].astype(np.uint64) << (32 - n - (begin & 7)).astype(np.uint64)
        at, total = begin >> 3, int(after[-1]) if len(after) else 0
        out = np.zeros(total + 4)
        for k in range(4):
            part = (word >> np.uint64(24 - 8 * k)) & np.uint64(255)
            # codes do not overlap, so sums of their bytes are their union
            out += np.bincount(at + k, weights=part.astype(np.float64), minlength=total + 4)
        return out[:total].astype(np.uint8).tobytes(), after, own[marked], np.searchsorted(marked, bounds[1:])

    def decode(self, data: bytes, starts, counts):
        """The ids of lanes that begin at bit `starts` and have `counts` ids each, one lane after the other."""
        import numpy as np

        raw = np.frombuffer(data + b"\0" * 8, np.uint8)
        words = (raw[:-3].astype(np.uint32) << 24) | (raw[1:-2].astype(np.uint32) << 16) | (raw[2:-1].astype(np.uint32) << 8) | raw[3:]
        counts = np.asarray(counts, np.int64)
        offset = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), np.uint32)
        lanes = np.argsort(-counts, kind="stable")
        at, to, left = np.asarray(starts, np.int64)[lanes], offset[lanes], counts[lanes]
        mask = (1 << self.max) - 1
        for step in range(int(counts.max(initial=0))):
            live = int(np.searchsorted(-left, -step, side="left"))
            if live < len(at):
                at, to, left = at[:live], to[:live], left[:live]
            peek = (words[at >> 3] >> (32 - self.max - (at & 7)).astype(np.uint32)) & mask
            out[to + step] = self.symbol[peek]
            at = at + self.bits[peek]
        return out


# --- chunks ---


def pack(docs: list[tuple]) -> bytes:
    """One block of documents (n_ids, checkpoints as bytes, coded bytes): magic, number of documents and of checkpoints, n_ids of each,
    bit offsets of all checkpoints, then the bits."""
    import numpy as np

    at, lanes = 0, []
    for _, marks, data in docs:
        lanes.append(np.frombuffer(marks, np.uint32).astype(np.uint64) + np.uint64(8 * at))
        at += len(data)
    lanes = np.concatenate(lanes) if lanes else np.zeros(0, np.uint64)
    counts = np.array([n for n, _, _ in docs], np.uint32)
    return MAGIC + struct.pack("<II", len(docs), len(lanes)) + counts.tobytes() + lanes.tobytes() + b"".join(d for _, _, d in docs)


def unpack(code: Code, block: bytes):
    """(ids of all documents of a block, n_ids of each)."""
    import numpy as np

    if block[:8] != MAGIC:
        raise ValueError("not a block of this format")
    n_docs, n_lanes = struct.unpack_from("<II", block, 8)
    counts = np.frombuffer(block, np.uint32, n_docs, 16).astype(np.int64)
    starts = np.frombuffer(block, np.uint64, n_lanes, 16 + 4 * n_docs).astype(np.int64)
    per = -(-counts // STRIDE)
    last = np.cumsum(per) - 1
    lengths = np.full(n_lanes, STRIDE, np.int64)
    lengths[last] = counts - (per - 1) * STRIDE
    return code.decode(block[16 + 4 * n_docs + 8 * n_lanes :], starts, lengths), counts


# --- tokenizing ---


class Words:
    """Ids of texts, by words: the tokenizers this serves drop white space and never join what it parts.

    Known words and pre-tokens are kept in two generations of KNOWN_WORDS each: when the young one is full it becomes the old one, from which
    words in use move back. A new word in simple letters (below U+0250, where lower case and composition are plain) is cut into the
    pre-tokens of this kind of vocabulary, and the library's model cuts each new one. All other words go through the library's whole chain,
    as do all of a vocabulary for which a probe of both ways differs.
    """

    PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import numpy as np
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        one = lambda x: self.tokenizer.encode(x, add_special_tokens=False).ids
        if one("ab") + one("Cd1") != one("ab\n Cd1"):
            raise ValueError("this tokenizer does not take the words of a text one by one")
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.cut = regex.compile(self.PRETOKEN).findall
        # how byte-level vocabularies write the bytes of control characters and of letters beyond ASCII, by their rule: printable ones as themselves, others from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.bytes = {c: "".join(byte[b] for b in chr(c).encode()) for c in range(0x250)}
        probe = "it's Ab1, x-2... \u00c4\u00df\u00b2 \u0178'LL"
        self.marks = {m: np.array(one(m), self.kind).tobytes() for m in ".,;:!?"}
        self.simple = True
        self._learn(probe.split())
        self.simple = b"".join(self.young[w] for w in probe.split()) == np.array(one(probe), self.kind).tobytes()
        self.young = {}

    def _pieces(self, pieces: list[str]) -> None:
        """Learns pre-tokens in lower case: the library's model cuts each, which its whole chain would hand to it as it is."""
        import numpy as np

        cut, flat, at, table = self.tokenizer.model.tokenize, [], [], self.bytes
        for p in pieces:
            flat += [x.id for x in cut(p if p.isascii() and p.isprintable() else p.translate(table))]
            at.append(len(flat))
        raw, width = np.array(flat, self.kind).tobytes(), self.kind.itemsize
        at = [width * n for n in at]
        self.young.update(zip(pieces, [raw[a:b] for a, b in zip([0, *at], at)]))

    def _one_by_one(self, words: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        """Learns new words. Those of letters, and of letters with one mark after them, need no pattern."""
        young, every = self.young, "".join(new)
        if not self.simple or "<|" in every or not every.isascii():
            plain = [w for w in new if (w.isascii() or max(w) < "\u0250" and "\u0130" not in w) and "<|" not in w] if self.simple else []
            fast = set(plain)
            odd = [w for w in new if w not in fast]
            young.update(zip(odd, self._one_by_one(odd)))
        else:
            plain = new
        lower = every == every.lower()
        letters = [w for w in plain if w.isalpha()]
        rest = set(plain).difference(letters)
        marked = [w for w in rest if w[-1] in ".,;:!?" and w[:-1].isalpha()]
        bare = [w[:-1].lower() for w in marked]
        cut = [(w, self.cut(w.lower())) for w in rest.difference(marked)]
        small = letters if lower else [w.lower() for w in letters]
        self._pieces(list({*small, *bare, *[p for _, parts in cut for p in parts]}.difference(young)))
        if not lower:
            young.update(zip(letters, [young[w] for w in small]))
        marks = self.marks
        young.update(zip(marked, [young[p] + marks[w[-1]] for w, p in zip(marked, bare)]))
        young.update([(w, b"".join([young[p] for p in parts])) for w, parts in cut])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, with END_ID after them, as little-endian numbers of self.kind."""
        import numpy as np

        # where the tokenizer takes letters in any case for the same, one case will do: there are fewer words to know
        texts = [_lower(t) if self.simple and t else t for t in texts]
        # split() also parts at other white space, which these tokenizers drop as well, but for the four separators 0x1C-0x1F
        split = [[w.decode() for w in t.encode().split()] if t and _SEPARATORS(t) else (t or "").split() for t in texts]
        if len(self.young) > KNOWN_WORDS:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = set().union(*split).difference(young)
        if old:
            for w in [w for w in new if w in old]:
                young[w] = old[w]
                new.discard(w)
        if new:
            self._learn(list(new))
        end, get = np.array([END_ID], self.kind).tobytes(), young.__getitem__
        return [b"".join(map(get, words)) + end for words in split]


def _lower(text: str) -> str:
    """The text in lower case, if it has Latin-1 characters alone and no special token; as it is otherwise."""
    if "<|" in text:
        return text
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


_WORDS: dict[str, Words] = {}


def _words(path: str) -> Words:
    """One per worker process: what one task has learned serves the next."""
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


IDS = "doc_id long, n_ids long, width int, ids binary"


def tokenized(docs: DataFrame, tokenizer: str, step: int = 250) -> DataFrame:
    """doc_id, n_ids, width (bytes of an id), ids (little-endian) per row."""

    def made(batches: Iterator) -> Iterator:
        import pyarrow as pa

        words = _words(tokenizer)
        width = words.kind.itemsize
        for batch in batches:
            for k in range(0, batch.num_rows, step):
                ids = words.ids(batch.column(1).slice(k, step).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, step), pa.array([len(x) // width for x in ids], pa.int64()), pa.array([width] * len(ids), pa.int32()), pa.array(ids, pa.binary())], ["doc_id", "n_ids", "width", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(made, IDS)


def _arrays(batch, step: int = 250) -> Iterator[tuple]:
    """(first row, rows, all their ids in one array) for a few rows of IDS at a time."""
    import numpy as np

    for k in range(0, batch.num_rows, step):
        rows = batch.slice(k, step)
        width = rows.column(2)[0].as_py()
        yield k, rows, np.frombuffer(b"".join(rows.column(3).to_pylist()), f"<u{width}")


def count_ids(ids: DataFrame) -> list[tuple[int, int]]:
    """(id, count) over a table of IDS. As many rows as the vocabulary has ids."""

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for _, _, x in _arrays(batch):
                n = np.bincount(x, minlength=len(total))
                n[: len(total)] += total
                total = n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    sums = ids.mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return [(r["id"], r["n"]) for r in sums.collect()]


def _coded(ids: DataFrame, lengths) -> DataFrame:
    """doc_id, n_ids, marks, data per row of IDS."""

    def coded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        code = Code(lengths)
        for batch in batches:
            for _, rows, x in _arrays(batch):
                data, after, marks, upto = code.encode(x, np.cumsum(rows.column(1).to_numpy()))
                first, low = np.concatenate(([0], after)).tolist(), np.concatenate(([0], upto)).tolist()
                marks = marks.astype(np.uint32)
                blobs = [pa.array([v[a:b] if v is data else v[a:b].tobytes() for a, b in zip(c[:-1], c[1:])], pa.binary()) for v, c in ((marks, low), (data, first))]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *blobs], ["doc_id", "n_ids", "marks", "data"])

    return ids.mapInArrow(coded, "doc_id long, n_ids long, marks binary, data binary")


def _chunked(batches: Iterator) -> Iterator:
    """Rows in order become chunks of about CHUNK_BYTES."""
    import pyarrow as pa

    part, chunk, ids, docs, size = None, 0, [], [], 0

    def made():
        cols = [[part], [chunk], [ids], [len(docs)], [sum(d[0] for d in docs)], [pack(docs)]]
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["part", "chunk", "doc_ids", "n_docs", "n_ids", "block"])

    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            part = row[0]
            ids.append(row[1])
            docs.append(row[2:])
            size += len(row[4])
            if size >= CHUNK_BYTES:
                yield made()
                chunk, ids, docs, size = chunk + 1, [], [], 0
    if docs:
        yield made()


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, max_bits: int = MAX_BITS, partitions: int | None = None) -> None:
    """Writes the ids of docs(doc_id, text) under `path`: `code` (one row with the code lengths) and `chunks`, in ascending doc_id order."""
    spark = docs.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    raw = written(tokenized(docs, tokenizer), f"{work_dir(spark)}/raw_ids", compression="zstd")
    found = count_ids(raw)
    counts = [0] * (1 + max([i for i, _ in found], default=0))
    for i, n in found:
        counts[i] = n
    lengths = code_lengths(counts, max_bits)
    spark.createDataFrame([(bytearray(lengths.tobytes()), STRIDE)], "lengths binary, stride int").coalesce(1).write.mode("overwrite").parquet(f"{path}/code")
    # the hash parts rows with one doc_id; it sets the order among them, too. The coded rows are a table: the bounds of the ranges are
    # drawn from two narrow columns of it, and nothing is coded twice
    rows = written(_coded(raw, lengths).withColumn("tie", F.xxhash64("n_ids", "data")), f"{work_dir(spark)}/coded", compression="none")
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    rows.select(F.spark_partition_id().alias("part"), "doc_id", "n_ids", "marks", "data").mapInArrow(_chunked, FILES).write.mode("overwrite").option("compression", "none").parquet(f"{path}/chunks")


def _lengths(spark: SparkSession, path: str):
    import numpy as np

    return np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first()["lengths"]), np.uint8)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """part, chunk, own (ids of the chunk's documents before this one), doc_id, n_ids and ids (or, as a digest, their ids_crc32) per
    document, decoded from the files."""
    lengths = _lengths(spark, path)

    def read(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pyarrow as pa

        code = Code(lengths)
        for batch in batches:
            for r in range(batch.num_rows):
                part, chunk, doc_ids, block = (batch.column(k)[r].as_py() for k in range(4))
                ids, counts = unpack(code, block)
                ends = np.cumsum(counts)
                raw = ids.astype("<u4")
                each = [raw[e - n : e] for e, n in zip(ends.tolist(), counts.tolist())]
                last = pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()) if digest else pa.array(each, pa.list_(pa.int64()))
                cols = [pa.array([part] * len(each), pa.int32()), pa.array([chunk] * len(each), pa.int32()), pa.array(ends - counts, pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(counts, pa.int64()), last]
                yield pa.RecordBatch.from_arrays(cols, ["part", "chunk", "own", "doc_id", "n_ids", "ids_crc32" if digest else "ids"])

    chunks = spark.read.schema(FILES).parquet(f"{path}/chunks").select("part", "chunk", "doc_ids", "block")
    return chunks.mapInArrow(read, "part int, chunk int, own long, doc_id long, n_ids long, " + ("ids_crc32 long" if digest else "ids array<long>"))


def with_starts(read: DataFrame, chunks: DataFrame) -> DataFrame:
    """Adds start: the number of ids of all documents before this one. Sums go by part and by chunk in its part; the decoder gives the rest."""
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunks.select("part", "chunk", F.coalesce(F.sum("n_ids").over(inside), F.lit(0)).alias("chunk_start")).join(parts, "part")
    return read.join(bases, ["part", "chunk"]).withColumn("start", (F.col("part_start") + F.col("chunk_start") + F.col("own")).cast("long")).drop("part_start", "chunk_start", "own")


def round_trip(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 per row of docs(doc_id, text), from the files that write_ids makes of it.

    Null and empty texts have one id, the end. A null doc_id comes first. Rows with one doc_id are documents of their own, in an order
    that their ids set; equal ones are alike. An empty table gives an empty result; other columns are not looked at.
    """
    spark = docs.sparkSession
    path = path or f"{work_dir(spark)}/ids"
    write_ids(docs, path, tokenizer)
    found = with_starts(read_ids(spark, path, digest=True), spark.read.schema(FILES).parquet(f"{path}/chunks").select("part", "chunk", "n_ids"))
    return found.select("doc_id", "start", F.col("n_ids").alias("n_tokens"), "ids_crc32")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))
