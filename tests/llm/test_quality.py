import random
import re
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import quality as Q

from .conftest import prose


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é#|\n\t\x0b\x1c 日"), max_size=80))
def test_counts(text):
    assert Q.counts(text.encode())[:5] == brute(text)


def test_query_equals_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in Q.op8(spark, sf).collect():
        b = brute(docs[r["doc_id"]])
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        assert [r[c] for c in Q.COUNTS] == b and r["base_failed"] == failed and not (failed and r["kept"])


def test_forest_finds_what_is_unlike(spark):
    r = random.Random(4)
    good = [(i, prose(i, 60 + r.randrange(200))) for i in range(400)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i, 90).split())) for i in range(40)]
    docs = spark.createDataFrame(good + junk, "doc_id long, text string")
    labels = spark.createDataFrame([(d, int(d < 1000)) for d, _ in good[:200] + junk[:10]], "doc_id long, quality int")
    kept = {x["doc_id"] for x in Q.judge_documents(docs, labels).where("kept").collect()}
    assert sum(d in kept for d, _ in good) >= 396 and not any(d in kept for d, _ in junk)
    assert {x["doc_id"] for x in Q.keep_good(docs, labels).collect()} == kept


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (None, 1), (4, None), (6, 0)], "doc_id long, quality int")
    rows = Q.judge_documents(odd, labels).collect()
    assert len(rows) == odd.count() and sorted([x[c] for c in Q.COUNTS] for x in rows) == sorted(brute(x["text"]) for x in odd.collect())
    kept = Q.keep_good(odd, labels)
    assert kept.columns == odd.columns and kept.count() == sum(x["kept"] for x in rows)
    assert Q.judge_documents(odd, labels.limit(0)).where("kept = base_failed").count() == 0
    assert Q.judge_documents(none, labels).count() == 0 and Q.keep_good(none, labels).count() == 0


def test_forest_scores_equal_a_walk_by_hand():
    """Each row goes down each tree one node at a time; the path counts a node per step, and what a leaf's rows would take."""
    r = np.random.default_rng(3)
    rows = r.random((150, 4)) * [1, 5, 0.1, 30]
    forest = Q.grow(rows, np.zeros(4), rows.max(0))
    for row, score in zip(rows[:40], Q.anomaly(forest, rows[:40])):
        total = 0.0
        for t in range(Q.TREES):
            k = 0
            while k < len(forest["feature"][t]) and forest["feature"][t][k] >= 0:
                k = 2 * k + 1 + int(row[forest["feature"][t][k]] > forest["cut"][t][k])
            total += forest["path"][t][k]
        assert abs(score - 2 ** (-total / Q.TREES / forest["scale"])) < 1e-9


def test_repeated_labels_count_once(spark):
    docs = spark.createDataFrame([(i, prose(i, 60 + i % 50)) for i in range(120)], "doc_id long, text string")
    once = [(i, int(i % 7 > 0)) for i in range(100)]
    one, many = (Q.fit(Q.rule_counts(docs), spark.createDataFrame(rows, "doc_id long, quality int")) for rows in (once, once * 3 + [(i, 1) for i in range(0, 100, 7)]))
    assert one["threshold"] == many["threshold"] and all((one["forest"][k] == many["forest"][k]).all() for k in ("feature", "cut", "path"))


def test_threshold():
    bins = [(600, 1, 1000), (800, 1, 4), (800, 0, 3), (1500, 0, 50), (700, 0, 9)]
    assert Q.threshold(bins) == 1301 / 4000 and Q.threshold([(600, 1, 5)]) == 2.0 and Q.threshold([]) == 2.0
    forest = Q.grow(np.random.default_rng(1).random((300, 10)) * 0.2, np.zeros(10), np.ones(10))
    near, far = Q.anomaly(forest, np.full((1, 10), 0.1)), Q.anomaly(forest, np.full((1, 10), 0.9))
    assert far[0] > near[0] + 0.1
