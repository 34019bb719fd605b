"""Operator 5, toxicity from the nearest labelled examples by exact TF-IDF cosine, with a block-max inverted index.

The labelled sample has FIT_ROWS rows of a label at most. Its label-associated terms (words and word beginnings) are the vocabulary, or,
with max_terms None, all its terms; their document frequencies come from all documents. Where terms are selected, the rest of a text is one
dimension that all texts share, of weight BACKGROUND: a vector's length would otherwise hide how much of a text the selected terms are. Each document's vector is searched in the index of the sample: blocks of examples
are visited by falling upper bound, the query's weights times each term's largest weight in the block, until no block can hold a nearer
neighbour. Examples of one vector are one entry with its numbers of labels, and all that are as near as the last neighbour vote: no id has a say. The neighbours' votes, weighted by similarity, are calibrated to scores on the sample itself, each row left out of its own
neighbours.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import least_hashed, table, work_dir, written

FIT_ROWS = 8000
#: Terms: lengths of word beginnings; the most; the least log-likelihood ratio (about one term in a million by chance); the least odds ratio.
PREFIXES, MAX_TERMS, MIN_G2, MIN_ODDS = (4, 5, 6), 2000, 24.0, 4.0
NEIGHBOURS, BLOCK, EVIDENCE = 15, 1024, 3
THRESHOLD = 0.7
#: Weight of the dimension for what is not selected, as of a rare term that occurs a few times.
BACKGROUND = 10.0
#: Pseudo-similarity of a vote for the labels' overall share.
PRIOR = 0.1

_TOKEN = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def terms(raw: str) -> list[str]:
    """Terms of a raw word: its lower-case letter runs, and the beginnings of longer ones."""
    out = []
    for w in _TOKEN.findall(raw.lower()):
        out.append(w)
        out += [f"{w[:n]}*" for n in PREFIXES if len(w) > n]
    return out


class _Cache(dict):
    """What a raw word counts for; kept up to a bound."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) > 300_000:
            self.clear()
        found = self[word] = self.make(word)
        return found


def vector(text: str | None, numbers: _Cache) -> dict[int, int]:
    """Term frequencies, by term number, of a whole text."""
    tf: dict[int, int] = {}
    for found in map(numbers.__getitem__, (text or "").split()):
        for t in found:
            tf[t] = tf.get(t, 0) + 1
    return tf


def weighted(tf: dict[int, int], idf, background: float = 0.0) -> list[tuple[int, float]]:
    """The unit vector of (1 + ln tf) idf, with the background as a last dimension if it has a weight."""
    import math

    w = [(t, (1 + math.log(n)) * idf[t]) for t, n in sorted(tf.items()) if idf[t] > 0]
    if background:
        w.append((len(idf), background))
    norm = math.sqrt(sum(x * x for _, x in w))
    return [(t, x / norm) for t, x in w] if norm else []


class Index:
    """Postings by term, cut into blocks of BLOCK examples, with the largest weight of each."""

    def __init__(self, vectors: list[list[tuple[int, float]]], n_terms: int, counts: list[int] | None = None):
        """counts: examples that have each vector, one if not given."""
        import numpy as np

        self.n, self.blocks = len(vectors), -(-len(vectors) // BLOCK) or 1
        self.counts = np.ones(self.n, np.int64) if counts is None else np.array(counts, np.int64)
        postings: dict[int, list] = defaultdict(list)
        for k, v in enumerate(vectors):
            for t, w in v:
                postings[t].append((k, w))
        self.largest = np.zeros((n_terms, self.blocks))
        self.postings: dict[int, dict[int, tuple]] = {}
        for t, found in postings.items():
            at, w = np.array([k for k, _ in found]), np.array([x for _, x in found])
            self.postings[t] = {}
            for b in np.unique(at // BLOCK).tolist():
                own = at // BLOCK == b
                self.postings[t][b] = (at[own] - b * BLOCK, w[own])
                self.largest[t, b] = w[own].max()

    def nearest(self, query: list[tuple[int, float]], k: int = NEIGHBOURS, without: dict[int, int] | None = None) -> list[tuple[float, int]]:
        """The vectors of the k examples of the largest positive cosines, exactly, and all that are as near as the last of them, nearest first.

        without: how many examples of a vector are left out.
        """
        import numpy as np

        if not query or not self.n:
            return []
        # scores are compared to 9 places, and so are their bounds
        bound = np.round(sum(x * self.largest[t] for t, x in query) + 1e-12, 9)
        best, at, least = np.zeros(0), np.zeros(0, np.int64), 0.0
        counts = self.counts
        if without:
            counts = counts.copy()
            for e, n in without.items():
                counts[e] -= n
        for b in np.lexsort((np.arange(self.blocks), -bound)).tolist():
            if bound[b] <= 0 or bound[b] < least:
                break
            score = np.zeros(BLOCK)
            for t, x in query:
                own = self.postings.get(t, {}).get(b)
                if own:
                    score[own[0]] += x * own[1]
            score = np.round(score, 9)
            new = np.flatnonzero((score > 0) & (score >= least))
            new = new[counts[new + b * BLOCK] > 0]
            if len(new):
                best, at = np.concatenate([best, score[new]]), np.concatenate([at, new + b * BLOCK])
                order = np.lexsort((at, -best))
                best, at = best[order], at[order]
                enough = np.flatnonzero(np.cumsum(counts[at]) >= k)
                if len(enough):
                    least = best[enough[0]]
                    best, at = best[best >= least], at[best >= least]
        return list(zip(best.tolist(), at.tolist()))


def vote(found: list[tuple[float, int, int]], weight: tuple[float, float], prior: float) -> float:
    """Share of label 1 among neighbours by similarity and label weight; the overall share counts as a neighbour of similarity PRIOR.
    found: similarity, examples of label 0, of label 1."""
    one = sum(s * weight[1] * n1 for s, _, n1 in found)
    both = sum(s * (weight[0] * n0 + weight[1] * n1) for s, n0, n1 in found)
    return (one + PRIOR * prior) / (both + PRIOR)


def isotonic(pairs: list[tuple[float, int, float]]) -> tuple[list[float], list[float]]:
    """Steps (from which vote, score): the rising function nearest to the labels. pairs: vote, label, weight."""
    sums: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for v, y, w in pairs:
        sums[v][0] += w * y
        sums[v][1] += w
    pools: list[list[float]] = []
    for v in sorted(sums):
        pools.append([v, *sums[v]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, y, w = pools.pop()
            pools[-1][1] += y
            pools[-1][2] += w
    return [p[0] for p in pools], [p[1] / p[2] for p in pools]


class Model:
    """Everything that scoring needs; its size is bounded by FIT_ROWS and MAX_TERMS."""

    def __init__(self, names: list[str], idf: list[float], sample: list[tuple], share: float, background: float = 0.0):
        """sample: (id, text key, term frequencies, label). Its order is nothing."""
        self.idf, self.background = idf, background
        each = [tuple(weighted(x[2], idf, background)) for x in sample]
        vectors = sorted(set(each))
        number = {v: g for g, v in enumerate(vectors)}
        #: of each vector, examples of label 0 and 1; of each text, examples with it by vector; a few ids of each vector, as evidence
        self.labels = [[0, 0] for _ in vectors]
        self.same: dict[int, dict[int, list[int]]] = {}
        self.ids: list[list] = [[] for _ in vectors]
        for x, v in zip(sample, each):
            g = number[v]
            self.labels[g][x[3]] += 1
            self.same.setdefault(x[1], {}).setdefault(g, [0, 0])[x[3]] += 1
            self.ids[g].append((x[0], x[3]))
        self.ids = [sorted(i, key=lambda x: (str(x[0]), x[1]))[:EVIDENCE] for i in self.ids]
        self.index = Index([list(v) for v in vectors], len(names) + 1, [sum(n) for n in self.labels])
        self.prior = share
        n0, n1 = (sum(n[y] for n in self.labels) for y in (0, 1))
        # a label's rows stand for all its learnable rows
        self.weight = ((1 - share) / n0 if n0 else 0.0, share / n1 if n1 else 0.0)
        top = max(self.weight) or 1.0
        self.weight = (self.weight[0] / top, self.weight[1] / top)
        # examples with one text and one vector have one vote
        known: dict[tuple, float] = {}
        votes = []
        for x, v in zip(sample, each):
            key = (x[1], v)
            if key not in known:
                known[key] = self._vote(v, self.same[x[1]])[0]
            votes.append((known[key], x[3], self.weight[x[3]]))
        self.steps = isotonic(sorted(votes))
        self.seen: dict[tuple, tuple] = {}

    def _vote(self, query, without: dict[int, list[int]]) -> tuple[float, list[tuple[float, int]]]:
        found = self.index.nearest(list(query), without={g: sum(n) for g, n in without.items()})
        left = [(s, *(n - m for n, m in zip(self.labels[g], without.get(g, (0, 0))))) for s, g in found]
        return round(vote(left, self.weight, self.prior), 6), found

    def score(self, tf: dict[int, int], text_key: int | None = None) -> tuple[float, str]:
        """(score, evidence: the nearest examples' ids, labels and similarities). An example with the same text is none, so that no score
        is read off its own label."""
        if text_key in self.same:
            return self._score(tf, self.same[text_key])
        key = tuple(sorted(tf.items()))
        if key not in self.seen:
            if len(self.seen) > 100_000:
                self.seen.clear()
            self.seen[key] = self._score(tf, {})
        return self.seen[key]

    def _score(self, tf: dict[int, int], without: dict[int, list[int]]) -> tuple[float, str]:
        import bisect

        v, found = self._vote(weighted(tf, self.idf, self.background), without)
        k = bisect.bisect_right(self.steps[0], v) - 1
        score = self.steps[1][max(k, 0)] if self.steps[1] else self.prior
        # texts without a term have all such texts as neighbours: these are no evidence
        return score, ",".join([f"{i}:{y}:{s:.3f}" for s, g in found for i, y in self.ids[g]][:EVIDENCE]) if tf else ""


def _sample(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, float]:
    """(doc_id, toxic, key of the text, terms, tf) of the labelled sample, 2 x FIT_ROWS rows at most, and the share of label 1 among all learnable labels."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    size = known.agg(F.count("*").alias("n"), F.sum("toxic").alias("n1")).first()
    # the texts of the least hashes of each label: 2 x FIT_ROWS at most. Ids have no say in what is an example, but for equal texts, which are equal examples
    spark = docs.sparkSession
    path = work_dir(spark)
    texts = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("key")).join(known, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("key").alias("key"))
    texts = written(texts, f"{path}/labelled")
    chosen = texts.limit(0)
    for y in (0, 1):
        chosen = chosen.union(least_hashed(texts.where(f"toxic = {y}"), "key", FIT_ROWS, "doc_id"))
    chosen = written(chosen.select(F.col("doc_id").alias("__rl_id"), F.col("toxic").cast("int").alias("toxic")), f"{path}/chosen")
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("__rl_id"))
    # of an id that several rows have, the text of the least hash
    one = found.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min(F.struct(F.xxhash64("text").alias("key"), "text")).alias("x")).select("doc_id", "toxic", "x.key", "x.text")

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = _Cache(lambda w: tuple(terms(w)))
        for b in batches:
            rows = [sorted(vector(b.column(3)[k].as_py(), cache).items()) for k in range(b.num_rows)]
            lists = [pa.array([[t for t, _ in r] for r in rows], pa.list_(pa.string())), pa.array([[n for _, n in r] for r in rows], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int32()), b.column(2), *lists], ["doc_id", "toxic", "key", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return one.mapInArrow(counted, f"doc_id {kind}, toxic int, key long, terms array<string>, tf array<int>"), (size["n1"] or 0) / size["n"] if size["n"] else 0.0


def document_frequencies(vectors: DataFrame, n_terms: int) -> dict[int, int]:
    """How many rows of vectors(terms) have each term number. Each task sums its own; no row is made for a document's term."""

    def counted(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        total = np.zeros(n_terms, np.int64)
        for b in batches:
            total += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms)[:n_terms]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["t", "n"])

    sums = vectors.select("terms").mapInArrow(counted, "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))
    return {r["t"]: r["n"] for r in sums.collect()}


def score_documents(docs: DataFrame, labels: DataFrame, max_terms: int | None = MAX_TERMS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence per row of docs(doc_id, text); labels(doc_id, toxic) has toxic 1 for toxic, 0 else.

    Labels are learned from rows alone whose crc32(doc_id) mod 3 is not 1. Null and empty texts, and texts without a known term, have one
    score, that of such rows of the sample. A null doc_id is not held out. Labels with null ids or values are not
    used; an id labelled twice has the larger label, and an id with several texts is one example, with one of them; without labels all
    scores are 0. Equal texts score alike, and no text is an example for itself. An empty table gives an empty result; other columns
    are not looked at. With max_terms None, every term of the sample is a dimension, and there is no background.
    """
    spark = docs.sparkSession
    path = work_dir(spark)
    sample, share = _sample(docs, labels)
    sample = written(sample, f"{path}/sample")
    # which terms go with which label: sums over the sample's rows, of which there are 2 x FIT_ROWS at most
    by_term = sample.select("toxic", F.explode("terms").alias("t")).groupBy("t").agg(F.sum("toxic").alias("a"), F.count("*").alias("n"))
    sizes = sample.agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).first()
    names = [r["t"] for r in by_term.select("t").orderBy("t").collect()] if max_terms is None else select_terms_of(by_term, sizes["n1"] or 0, sizes["n"], max_terms)
    number = {t: k for k, t in enumerate(names)}
    kind = docs.schema["doc_id"].dataType.simpleString()

    def vectors(batches: Iterator) -> Iterator:
        import pyarrow as pa

        cache = _Cache(lambda w: tuple(number[t] for t in terms(w) if t in number))
        for b in batches:
            rows = [vector(b.column(2)[k].as_py(), cache) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([list(r) for r in rows], pa.list_(pa.int32())), pa.array([list(r.values()) for r in rows], pa.list_(pa.int32()))], ["doc_id", "key", "terms", "tf"])

    found = written(docs.select("doc_id", F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text")).mapInArrow(vectors, f"doc_id {kind}, key long, terms array<int>, tf array<int>"), f"{path}/vectors")
    df = document_frequencies(found, len(names))
    model = make_model(names, df, found.count(), sample, share, 0.0 if max_terms is None else BACKGROUND)
    sent = spark.sparkContext.broadcast(model)

    def scored(batches: Iterator) -> Iterator:
        import pyarrow as pa

        m = sent.value
        for b in batches:
            out = [m.score(dict(zip(b.column(2)[k].as_py(), b.column(3)[k].as_py())), b.column(4)[k].as_py()) for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([s for s, _ in out], pa.float64()), pa.array([int(s >= THRESHOLD) for s, _ in out], pa.int32()), pa.array([e for _, e in out], pa.string())], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "terms", "tf", "key").mapInArrow(scored, f"doc_id {kind}, held_out boolean, score double, predicted int, evidence string")


def select_terms_of(by_term: DataFrame, n1: int, n: int, limit: int = MAX_TERMS) -> list[str]:
    """The terms that go most with one label: by log-likelihood ratio, of those with a clear odds ratio. by_term: t, a (rows with label 1), n."""
    n0 = n - n1
    if not n1 or not n0:
        return []
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    c, d = F.lit(n1) - a, F.lit(n0) - b
    # 2 sum of O ln(O / E) over the four cells; few expected rows do not inflate it as they do Pearson's sum
    cell = lambda x, row, col: F.when(x > 0, x * F.log(x * n / (row * col))).otherwise(F.lit(0.0))
    g2 = 2 * (cell(a, a + b, F.lit(float(n1))) + cell(b, a + b, F.lit(float(n0))) + cell(c, c + d, F.lit(float(n1))) + cell(d, c + d, F.lit(float(n0))))
    odds = (a + 0.5) * (d + 0.5) / ((b + 0.5) * (c + 0.5))
    best = by_term.where(F.col("n") < n).select("t", F.round(g2, 6).alias("g2"), odds.alias("odds"))
    best = best.where((F.col("g2") >= MIN_G2) & (F.greatest("odds", 1 / F.col("odds")) >= MIN_ODDS))
    return [r["t"] for r in best.orderBy(F.desc("g2"), "t").limit(limit).collect()]


def make_model(names: list[str], df: dict[int, int], n_docs: int, sample: DataFrame, share: float, background: float) -> Model:
    """sample: doc_id, toxic, key, terms, tf; 2 x FIT_ROWS rows at most. What is collected of it are the terms in `names`."""
    import math

    number = {t: k for k, t in enumerate(names)}

    def numbered(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows = [[(number[t], n) for t, n in zip(b.column(3)[k].as_py(), b.column(4)[k].as_py()) if t in number] for k in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *[pa.array([[x[i] for x in r] for r in rows], pa.list_(pa.int32())) for i in (0, 1)]], ["doc_id", "toxic", "key", "terms", "tf"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    examples = sample.mapInArrow(numbered, f"doc_id {kind}, toxic int, key long, terms array<int>, tf array<int>")
    idf = [math.log(n_docs / df[k]) if df.get(k) else 0.0 for k in range(len(names))]
    rows = [(r["doc_id"], r["key"], dict(zip(r["terms"], r["tf"])), r["toxic"]) for r in examples.collect()]
    return Model(names, idf, rows, share, background)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
