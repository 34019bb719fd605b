"""Operator 11, spelling variant grouping: frequent words one edit apart, each with the most frequent much commoner one as its form.

Words are counted in tasks, then in one shuffle. The vocabulary, in sorted order, is cut into shards, each a compact trie: nodes in breadth-first order,
so that a node's children lie side by side, one character and one number a node. A shard has at most SHARD_WORDS words of at most LONGEST code
points each in one trie, so its size is bounded; shards go out a few at a time. Each word's distance-one Levenshtein automaton is intersected with every
shard depth-first: its states are a place in the word and whether the edit is spent. The accepting neighbours are reduced to their number
and the best of them, in each task, then over the shards. Roots are found by pointer doubling.
"""

from __future__ import annotations

import array
import re
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table, work_dir, written

#: Letters of a word; least code points and occurrences of a word; how much more frequent a form is; what part of the runs loses a character.
LETTERS, LEAST_LENGTH, LEAST_COUNT, TIMES, EVERY = "A-Za-zÀ-ÿ", 6, 5, 5, 199
#: Words of a shard; characters of a shard, at which it ends even before that; shards that are sent at once (some 6 MB each at most).
SHARD_WORDS, SHARD_CHARS, SHARDS_AT_ONCE = 100_000, 1_000_000, 8
#: Distinct words that a task counts before it hands them on.
HELD = 500_000


def typo(run: str, prefix: int) -> str:
    """The run without one character, if its hash says so. prefix: the crc32 of what is hashed before it."""
    h = zlib.crc32(run.encode(), prefix)
    if h % EVERY:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1 :]


def vocabulary(docs: DataFrame, path: str, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n: of all texts. A run shorter than the least length gives no word, as nothing is ever added to it."""

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        runs = re.compile(f"[{LETTERS}]+")
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])

        for b in batches:
            for k in range(0, b.num_rows, 500):
                for doc, text in zip(b.column(0).slice(k, 500).to_pylist(), b.column(1).slice(k, 500).to_pylist()):
                    if text:
                        prefix = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                        for run, n in Counter(runs.findall(text.lower().decode())).items():  # bytes.lower() knows A-Z alone
                            if len(run) >= least_length:
                                word = typo(run, prefix)
                                if len(word) >= least_length:
                                    seen[word] += n
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    words = texts.mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)
    return written(words, f"{path}/vocabulary")


class Trie:
    """Sorted distinct words with numbers of theirs. labels[v] is the character that leads to node v, children of v are first[v] to first[v + 1],
    ends[v] is the place of the word that ends in v, from 1, or 0."""

    def __init__(self, labels: str, first: array.array, ends: array.array, counts: array.array):
        self.labels, self.first, self.ends, self.counts = labels, first, ends, counts

    @classmethod
    def of(cls, words: list[str], counts: list[int]) -> Trie:
        labels, first, ends = ["\0"], array.array("I"), array.array("I")
        level, depth = [(0, len(words))], 0
        while level:
            below = []
            for i, j in level:
                ends.append(i + 1 if len(words[i]) == depth else 0)
                first.append(len(labels))
                i += len(words[i]) == depth
                while i < j:
                    c, k = words[i][depth], i + 1
                    while k < j and words[k][depth] == c:
                        k += 1
                    labels.append(c)
                    below.append((i, k))
                    i = k
            level, depth = below, depth + 1
        first.append(len(labels))
        return cls("".join(labels), first, ends, array.array("Q", counts))

    def pack(self) -> bytes:
        parts = [self.labels.encode("utf-8", "surrogatepass"), self.first.tobytes(), self.ends.tobytes(), self.counts.tobytes()]
        return array.array("Q", map(len, parts)).tobytes() + b"".join(parts)

    @classmethod
    def unpack(cls, blob: bytes) -> Trie:
        sizes, at, parts = array.array("Q", blob[:32]), 32, []
        for n in sizes:
            parts.append(blob[at : at + n])
            at += n
        return cls(parts[0].decode("utf-8", "surrogatepass"), array.array("I", parts[1]), array.array("I", parts[2]), array.array("Q", parts[3]))

    def near(self, word: str) -> dict[str, int]:
        """The trie's words one edit from this one, with their numbers, depth-first: along the word's own path the edit is still to spend; at
        each node it is spent in every way, and what is left of the word must follow."""
        labels, first, ends, counts, size = self.labels, self.first, self.ends, self.counts, len(word)
        found: dict[str, int] = {}

        def rest(v: int, i: int) -> int:
            """The place of the word that the rest from i on ends in, below v; 0 if none."""
            while i < size:
                v = labels.find(word[i], first[v], first[v + 1])
                if v < 0:
                    return 0
                i += 1
            return ends[v]

        v = 0
        for i in range(size + 1):
            low, high = first[v], first[v + 1]
            own = word[i] if i < size else ""
            after = word[i + 1] if i + 1 < size else ""
            if own and (e := rest(v, i + 1)):
                found[word[:i] + word[i + 1 :]] = counts[e - 1]
            for c in range(low, high):
                a, b = first[c], first[c + 1]
                if (ends[c] if not own else a < b and labels.find(own, a, b) >= 0) and (e := rest(c, i)):
                    found[word[:i] + labels[c] + word[i:]] = counts[e - 1]
                if own and labels[c] != own and (ends[c] if not after else a < b and labels.find(after, a, b) >= 0) and (e := rest(c, i + 1)):
                    found[word[:i] + labels[c] + word[i + 1 :]] = counts[e - 1]
            if not own or (v := labels.find(own, low, high)) < 0:
                break
        return found


def trie_shards(words: DataFrame, path: str, shard_words: int = SHARD_WORDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """number, shard binary: packed tries of the words in sorted order, each of shard_words words and shard_chars characters at most (a longer word is alone).

    A word's place in the order is its place in its range partition after the sizes of those before it, so that shards are full however many
    partitions there are.
    """
    spark = words.sparkSession
    ordered = written(words.select("word", "n").repartitionByRange("word").sortWithinPartitions("word").withColumn("at", F.monotonically_increasing_id()), f"{path}/ordered")
    ordered = ordered.select("word", "n", F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1).alias("inside"))
    sizes, before = [], 0
    for r in ordered.groupBy("part").count().orderBy("part").collect():
        sizes.append((r["part"], before))
        before += r["count"]
    if not sizes:
        return spark.createDataFrame([], "number long, shard binary")
    dealt = ordered.join(F.broadcast(spark.createDataFrame(sizes, "part long, before long")), "part").select("word", "n", F.floor((F.col("before") + F.col("inside")) / shard_words).alias("shard"))

    def built(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held: list[str] = []
        numbers: list[int] = []
        size, at, more = 0, None, 0  # more: tries of a shard whose characters were too many for one

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at << 20 | more]), pa.array([Trie.of(held, numbers).pack()], pa.binary())], ["number", "shard"])

        for b in batches:
            for word, n, shard in zip(*(c.to_pylist() for c in b.columns)):
                if held and (shard != at or size + len(word) > shard_chars):
                    yield out()
                    held.clear()
                    numbers.clear()
                    size, more = 0, more + 1 if shard == at else 0
                at = shard
                held.append(word)
                numbers.append(n)
                size += len(word)
        if held:
            yield out()

    return dealt.repartition(-(-before // shard_words), "shard").sortWithinPartitions("shard", "word").mapInArrow(built, "number long, shard binary")


def neighbours(words: DataFrame, path: str, shard_words: int = SHARD_WORDS, at_once: int = SHARDS_AT_ONCE) -> DataFrame:
    """word, n, n_near, best struct<order, word> (the near word of largest n, first in code-point order; order is -n), of words(word, n)."""
    spark = words.sparkSession
    shards = written(trie_shards(words, path, shard_words), f"{path}/shards")
    numbers = [r[0] for r in shards.select("number").orderBy("number").collect()]
    dealt = words.select("word", "n").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "word")
    parts = []
    for k in range(0, len(numbers), at_once):
        sent = spark.sparkContext.broadcast([bytes(r[0]) for r in shards.where(F.col("number").between(numbers[k], numbers[min(k + at_once, len(numbers)) - 1])).select("shard").collect()])

        def matched(batches: Iterator, sent=sent) -> Iterator:
            import pyarrow as pa

            tries = [Trie.unpack(x) for x in sent.value]
            for b in batches:
                total, best_n, best = [], [], []
                for word in b.column(0).to_pylist():
                    found = [x for t in tries for x in t.near(word).items()]
                    top = min(((-m, w) for w, m in found), default=(None, None))
                    total.append(len(found))
                    best_n.append(top[0])
                    best.append(top[1])
                near = pa.StructArray.from_arrays([pa.array(best_n, pa.int64()), pa.array(best, pa.string())], ["order", "word"], mask=pa.array([x is None for x in best]))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(total, pa.int64()), near], ["word", "n", "n_near", "best"])

        parts.append(written(dealt.mapInArrow(matched, "word string, n long, n_near long, best struct<order: long, word: string>"), f"{path}/near{k}"))
        sent.destroy()
    if not parts:
        return words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<order: long, word: string>").alias("best"))
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("word", "n").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, path: str) -> DataFrame:
    """r_word, root: where the forms of each word(word, form) end. Forms get more frequent from step to step, so there is no circle; each turn
    doubles the steps that are behind."""
    now = written(forms.select("word", F.col("form").alias("root")), f"{path}/roots0")
    turn = 0
    while True:
        turn += 1
        ahead = now.select(F.col("word").alias("a_word"), F.col("root").alias("a_root"))
        later = written(now.join(ahead, F.col("root") == F.col("a_word"), "left").select("word", F.coalesce("a_root", "root").alias("root"), F.col("a_root").isNotNull().alias("moved")), f"{path}/roots{turn}")
        now = later.select("word", "root")
        if not later.where("moved").take(1):
            return now.select(F.col("word").alias("r_word"), "root")


def variants(docs: DataFrame, times: int = TIMES, shard_words: int = SHARD_WORDS, at_once: int = SHARDS_AT_ONCE, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n, n_near, form, form_n, root, of every word of enough code points and occurrences in docs(doc_id, text).

    Null and empty texts have no words. Each row is a document, repeated ones too; a null id counts as the empty string where runs are hashed. Of
    near words that are equally frequent the first in code-point order is the form. Long texts are taken whole. An empty table, or one without
    frequent words, gives no rows; other columns are not looked at.
    """
    path = work_dir(docs.sparkSession)
    words = vocabulary(docs, path, least_length, least_count)
    found = neighbours(words, path, shard_words, at_once)
    enough = -F.col("best.order") >= times * F.col("n")
    found = written(found.select("word", "n", "n_near", F.when(enough, F.col("best.word")).alias("form"), F.when(enough, -F.col("best.order")).alias("form_n")), f"{path}/forms")
    ends = roots(found.where("form is not null"), path)
    return found.join(ends, F.col("word") == F.col("r_word"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
