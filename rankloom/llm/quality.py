"""Operator 8, quality rules with an isolation forest on rule statistics.

One pass counts rule statistics of every whole text. An isolation forest is grown from a bounded sample of rows labelled good; its split
points are drawn from the box that the statistics of all documents span, so that a document unlike the good ones soon stands alone: a
short mean path. The threshold on that score is set by all labelled rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import least_hashed, table, work_dir, written

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Bound of the sample that the forest is grown from; rows per tree; trees; depth.
FIT_ROWS, TREE_ROWS, TREES, DEPTH = 8192, 256, 200, 8
#: Of the rows labelled good, so many may be rejected at most.
GOOD_LOSS = 0.005
SEED = 7

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further counts that the forest's statistics are made of.
MORE = ["n_lines", "n_distinct", "n_upper", "n_digits", "n_marks"]
STATISTICS = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "upper", "digits", "marks", "line_words"]

_WS, _CONT = b"\x20\x09\x0a\x0b\x0c\x0d", bytes(range(0x80, 0xC0))
_SYMBOLS, _UPPER, _DIGITS, _MARKS = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b"!?=_@~^\\/{}[]+"


def counts(text: bytes | None) -> list[int]:
    """COUNTS + MORE of one text; null is as empty."""
    import numpy as np

    text = text or b""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    ids = {w: i for i, w in enumerate(dict.fromkeys(words))}
    repeated = 0
    if n > 3:
        a = np.fromiter(map(ids.__getitem__, words), np.int64, n)
        pairs = a[:-1] * len(ids) + a[1:]
        if len(ids) > 1 << 20:
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(ids) + a[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        if same.any():
            twice = np.zeros(n - 2, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n, bool)
            for k in range(3):
                covered[k : n - 2 + k] |= twice
            repeated = int(covered.sum())
    less = lambda chars: len(text) - len(text.translate(None, chars))
    return [n, len(text.translate(None, _WS + _CONT)), less(_SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), len(ids), less(_UPPER), less(_DIGITS), less(_MARKS)]


def statistics(c):
    """Rows x STATISTICS from rows x (COUNTS + MORE)."""
    import numpy as np

    n, chars, symbols, dup, rep, lines, distinct, upper, digits, marks = np.asarray(c, float).reshape(-1, len(COUNTS) + len(MORE)).T
    w, ch, ln = np.maximum(n, 1), np.maximum(chars, 1), np.maximum(lines, 1)
    # distinct words fall with a text's length; log n words are the yardstick
    return np.column_stack([np.log1p(n), np.minimum(chars / w, 40), symbols / ch, dup / ln, rep / w, np.log1p(distinct) / np.log1p(w), upper / ch, digits / ch, marks / ch, np.log1p(n / ln)])


def base_failed(c):
    import numpy as np

    c = np.asarray(c).reshape(-1, len(COUNTS) + len(MORE))
    return (c[:, 0] < MIN_WORDS) | (100 * c[:, 4] > MAX_REPEAT_PERCENT * c[:, 0])


def _c(n: float) -> float:
    """Mean path of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(rows, low, high, seed: int = SEED) -> dict:
    """A forest as arrays [tree, node] over a full binary tree: node k has children 2k+1 and 2k+2; `path` is what a leaf counts."""
    import numpy as np

    rng, width, inner = np.random.default_rng(seed), rows.shape[1], 2**DEPTH - 1
    feature, cut, path = np.full((TREES, inner), -1, np.int16), np.zeros((TREES, inner)), np.zeros((TREES, 2 * inner + 1))
    for t in range(TREES):
        sample = rows[rng.permutation(len(rows))[:TREE_ROWS]]
        stack = [(0, 0, np.arange(len(sample)), low.copy(), high.copy())]
        while stack:
            k, depth, at, lo, hi = stack.pop()
            open_ = np.flatnonzero(hi > lo)
            if depth == DEPTH or len(at) <= 1 or not len(open_):
                path[t, k] = depth + _c(len(at))
                continue
            f = open_[rng.integers(len(open_))]
            x = rng.uniform(lo[f], hi[f])
            feature[t, k], cut[t, k] = f, x
            left = sample[at, f] <= x
            lo2, hi2 = lo.copy(), hi.copy()
            hi2[f], lo2[f] = x, x
            stack += [(2 * k + 1, depth + 1, at[left], lo, hi2), (2 * k + 2, depth + 1, at[~left], lo2, hi)]
    return {"feature": feature, "cut": cut, "path": path, "scale": _c(min(TREE_ROWS, len(rows))) or 1.0, "width": width}


def anomaly(forest: dict, rows):
    """Scores from 0 to 1 of rows of statistics; higher is less like the rows that the forest was grown from."""
    import numpy as np

    total, at_rows = np.zeros(len(rows)), np.arange(len(rows))
    for feature, cut, path in zip(forest["feature"], forest["cut"], forest["path"]):
        k = np.zeros(len(rows), np.int64)
        for _ in range(DEPTH):
            inner = k < len(feature)
            f = np.where(inner, feature[np.where(inner, k, 0)], -1)
            go = f >= 0
            k = np.where(go, 2 * k + 1 + (rows[at_rows, np.maximum(f, 0)] > cut[np.where(inner, k, 0)]), k)
        total += path[k]
    return np.exp2(-total / len(forest["path"]) / forest["scale"])


def _counted(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        *keys, text = batch.columns
        texts = text.cast(pa.binary())
        c = list(zip(*[counts(texts[i].as_py()) for i in range(len(texts))])) or [[] for _ in COUNTS + MORE]
        yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x, pa.int64()) for x in c]], [*batch.schema.names[:-1], *COUNTS, *MORE])


def rule_counts(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS + MORE per row."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_counted, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS + MORE))


def fit(counted: DataFrame, labels: DataFrame) -> dict:
    """Forest and threshold. The sample is of FIT_ROWS rows at most, those of the least hashed ids among the labelled good that pass the
    base rules; the box is of all documents, the threshold of all labelled rows that pass the base rules. Without such rows the
    threshold is 2: the method rejects nothing."""
    import numpy as np

    cols = COUNTS + MORE
    # the box that the forest cuts: from 0 to the largest value of any document
    edge = counted.agg(*[F.max(F.expr(x)).alias(f"m{i}") for i, x in enumerate(_sql_statistics())]).first()
    passed = counted.where(f"n_words >= {MIN_WORDS} and 100 * n_repeat_words <= {MAX_REPEAT_PERCENT} * n_words")
    one = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").alias("__rl_id")).agg(F.min("quality").alias("quality"))
    known = passed.join(one, F.col("doc_id") == F.col("__rl_id"))
    good = least_hashed(known.where("quality = 1"), "doc_id", FIT_ROWS, *cols).select(*cols).collect()
    if len(good) < 2:
        return {"forest": None, "threshold": 2.0}
    rows = statistics([tuple(r) for r in good])
    high = np.maximum(np.array([edge[f"m{i}"] for i in range(len(STATISTICS))], float), 1e-9)
    low = np.zeros(len(STATISTICS))
    forest = grow(rows, low, high)
    bins = known.select("doc_id", "quality", *cols).mapInArrow(lambda b: _binned(b, forest), "score int, quality int").groupBy("score", "quality").count().collect()
    return {"forest": forest, "threshold": threshold([(r["score"], r["quality"], r["count"]) for r in bins])}


def _sql_statistics() -> list[str]:
    w, ch, ln = "greatest(n_words, 1)", "greatest(word_chars, 1)", "greatest(n_lines, 1)"
    return ["log1p(n_words)", f"least(word_chars / {w}, 40)", f"n_symbols / {ch}", f"n_dup_lines / {ln}", f"n_repeat_words / {w}", f"log1p(n_distinct) / log1p({w})", f"n_upper / {ch}", f"n_digits / {ch}", f"n_marks / {ch}", f"log1p(n_words / {ln})"]


def _binned(batches: Iterator, forest: dict) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        c = np.column_stack([batch.column(k + 2).to_numpy(zero_copy_only=False) for k in range(len(COUNTS + MORE))])
        s = np.floor(anomaly(forest, statistics(c)) * 2000).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(s), batch.column(1).cast(pa.int32())], ["score", "quality"])


def threshold(bins: list[tuple[int, int, int]]) -> float:
    """The score from which on documents are rejected; bins: score in steps of 1/2000, quality, rows.

    Of the bins that, rejected with all above, lose GOOD_LOSS of the good rows at most, the one that adds the last bad rows; the threshold
    lies midway between it and the next one below. 2 without bad rows: nothing is rejected.
    """
    good = sum(n for _, q, n in bins if q == 1)
    scores = sorted({s for s, _, _ in bins}, reverse=True)
    at, lost = 2.0, 0
    for s, below in zip(scores, [*scores[1:], None]):
        lost += sum(n for b, q, n in bins if b == s and q == 1)
        if lost > GOOD_LOSS * good:
            break
        if any(b == s and q == 0 for b, q, _ in bins):
            at = s / 2000 if below is None else (s + below + 1) / 4000
    return at


def _judged(c, model: dict):
    """(base_failed, kept, score) of rows of counts."""
    import numpy as np

    failed = base_failed(c)
    score = anomaly(model["forest"], statistics(c)) if model["forest"] and len(c) else np.zeros(len(c))
    return failed, ~failed & (score < model["threshold"]), score


def _scored(batches: Iterator, model: dict) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        c = np.column_stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(COUNTS + MORE))])
        failed, kept, score = _judged(c, model)
        yield pa.RecordBatch.from_arrays([*batch.columns[: 1 + len(COUNTS)], pa.array(failed), pa.array(kept), pa.array(score)], ["doc_id", *COUNTS, "base_failed", "kept", "anomaly"])


def judge_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, kept, anomaly per row of docs(doc_id, text); labels(doc_id, quality) has quality 1 for good, 0 for bad.

    Null and empty texts have zero counts and fail the base rules. Repeated rows are judged alike. Labels with null ids or qualities are
    not used; an id labelled more than once counts once, with its lowest label; without good labels only the base rules reject. An empty table gives an empty result; other columns are not looked at.
    """
    counted = written(rule_counts(docs), f"{work_dir(docs.sparkSession)}/counts")
    model = fit(counted, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return counted.mapInArrow(lambda b: _scored(b, model), f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, anomaly double")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge_documents keeps, with all their columns. Rows with null and empty texts go, as they fail the base rules;
    repeated rows stay or go together; without labels only the base rules reject; an empty table stays empty."""
    model = fit(written(rule_counts(docs), f"{work_dir(docs.sparkSession)}/counts"), labels)
    at = docs.columns.index("text")

    def kept(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            yield batch.filter(pa.array(_judged([counts(texts[i].as_py()) for i in range(len(texts))], model)[1])) if len(texts) else batch

    return docs.mapInArrow(kept, docs.schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
