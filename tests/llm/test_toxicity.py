import bisect
import math
import random
import zlib
from collections import Counter

import pytest

from rankloom.llm import toxicity as X

from .conftest import prose


@pytest.mark.parametrize("block", [8, 64, 1024])
def test_index_is_exact(monkeypatch, block):
    monkeypatch.setattr(X, "BLOCK", block)
    r = random.Random(1)
    vectors = []
    for _ in range(300):
        tf = {r.randrange(40): r.randrange(1, 4) for _ in range(r.randrange(0, 6))}
        vectors.append(X.weighted(tf, [1.0 + t % 5 for t in range(40)]))
    ix = X.Index(vectors, 40)
    for k, q in enumerate(vectors):
        dots = [(round(sum(x * dict(v).get(t, 0.0) for t, x in q), 9), e) for e, v in enumerate(vectors) if e != k]
        expected = sorted(((s, e) for s, e in dots if s > 0), key=lambda x: (-x[0], x[1]))
        expected = [x for x in expected if x[0] >= expected[: X.NEIGHBOURS][-1][0]]  # and all ties
        got = ix.nearest(q, without={k: 1})
        assert [e for _, e in got] == [e for _, e in expected] and [s for s, _ in got] == pytest.approx([s for s, _ in expected])


def test_isotonic():
    assert X.isotonic([(0.1, 0, 1), (0.2, 1, 1), (0.3, 0, 1), (0.9, 1, 2)]) == ([0.1, 0.2, 0.9], [0.0, 0.5, 1.0])
    assert X.isotonic([]) == ([], [])


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(i, prose(i, 60) + (" vexor" + "abcdefgh"[i % 8] + " grumblat" if i % 5 == 0 else "")) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(1500)], "doc_id long, toxic int")
    return docs, labels, X.score_documents(docs, labels).collect()


def test_held_out_accuracy(scored):
    rows = scored[2]
    held = [r for r in rows if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i in range(1500) if zlib.crc32(str(i).encode()) % 3 == 1}
    right = sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in held)
    assert right / len(held) > 0.97 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_held_out_labels_are_not_used(spark, scored):
    docs, labels, rows = scored
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - toxic else toxic end as toxic")
    assert {r["doc_id"]: r["score"] for r in X.score_documents(docs, turned).collect()} == {r["doc_id"]: r["score"] for r in rows}


def test_ids_have_no_say(spark):
    """Other ids that keep the held-out rows, in another order, give the same scores, with a sample that is cut and one that is not."""
    rows = [(i, f"{prose(i % 40, 12)}" + (" vexor" if i % 3 == 0 else "")) for i in range(400)]
    label = {i: int(i % 3 == 0 or i % 17 == 0) for i in range(0, 400, 2)}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    pools = {h: iter([i for i in range(10**6, 10**6 + 9000) if held(i) == h][::-1]) for h in (False, True)}
    other = {i: next(pools[held(i)]) for i, _ in rows}
    for limit in (8000, 40):
        X.FIT_ROWS, kept = limit, X.FIT_ROWS
        try:
            one, two = (
                {back[r["doc_id"]]: r["score"] for r in X.score_documents(spark.createDataFrame([(ids[i], t) for i, t in rows], "doc_id long, text string"), spark.createDataFrame([(ids[i], y) for i, y in label.items()], "doc_id long, toxic int")).collect()}
                for ids in ({i: i for i, _ in rows}, other) for back in ({v: k for k, v in ids.items()},)
            )
        finally:
            X.FIT_ROWS = kept
        assert one == two and len(set(one.values())) > 1


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (6, None), (7, 7)], "doc_id long, toxic int")
    rows = X.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows) and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert {r["score"] for r in X.score_documents(odd, labels.limit(0)).collect()} == {0.0}
    assert X.score_documents(none, labels).count() == 0
    again = odd.union(odd).withColumnsRenamed({"size": "score", "kept": "held_out", "slot": "terms"})
    assert X.score_documents(again, labels.union(labels)).count() == 2 * odd.count()


def test_sample_is_bounded_by_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "FIT_ROWS", 10)
    docs = spark.range(5000).selectExpr("7L as doc_id", "concat('same id, text ', id) as text").union(spark.range(100, 200).selectExpr("id as doc_id", "concat('other ', id) as text"))
    labels = spark.range(100, 200).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic").union(spark.createDataFrame([(7, 1)] * 50, "doc_id long, toxic int"))
    sample = X._sample(docs, labels)[0]
    assert sample.count() <= 20 and sample.groupBy("doc_id").count().where("count > 1").count() == 0
    assert X.score_documents(docs, labels).count() == 5100


def brute(rows, label, max_terms):
    """Scores by all pairs: plain dictionaries, no index, no blocks. rows: (id, text); label: of the learnable ids."""
    tf = {i: Counter(t for w in (text or "").split() for t in X.terms(w)) for i, text in rows}
    texts = dict(rows)
    n1, n = sum(label.values()), len(label)
    a, every = Counter(t for i, y in label.items() if y for t in tf[i]), Counter(t for i in label for t in tf[i])

    def g2(t):
        cells = [(a[t], every[t], n1), (every[t] - a[t], every[t], n - n1), (n1 - a[t], n - every[t], n1), (n - n1 - every[t] + a[t], n - every[t], n - n1)]
        return 2 * sum(o * math.log(o * n / (r * c)) for o, r, c in cells if o > 0)

    def odds(t):
        x = (a[t] + 0.5) * (n - n1 - every[t] + a[t] + 0.5) / ((every[t] - a[t] + 0.5) * (n1 - a[t] + 0.5))
        return max(x, 1 / x)

    names = set(every)
    if max_terms is not None:
        names = set(sorted((t for t in every if every[t] < n and round(g2(t), 6) >= X.MIN_G2 and odds(t) >= X.MIN_ODDS), key=lambda t: (-round(g2(t), 6), t))[:max_terms])
    df = Counter(t for i, _ in rows for t in tf[i])
    vec = {}
    for i in tf:
        w = {t: (1 + math.log(k)) * math.log(len(rows) / df[t]) for t, k in tf[i].items() if t in names and df[t] < len(rows)}
        if max_terms is not None:
            w[None] = X.BACKGROUND
        norm = math.sqrt(sum(x * x for x in w.values()))
        vec[i] = {t: x / norm for t, x in w.items()} if norm else {}
    order = sorted(label)
    share = n1 / n
    weight = [(1 - share) / (n - n1), share / n1]
    weight = [w / max(weight) for w in weight]

    def voted(i):
        near = [(round(sum(x * vec[e].get(t, 0.0) for t, x in vec[i].items()), 9), k, e) for k, e in enumerate(order) if texts[e] != texts[i]]
        near = sorted((x for x in near if x[0] > 0), key=lambda x: (-x[0], x[1]))
        near = [x for x in near if x[0] >= near[: X.NEIGHBOURS][-1][0]]  # all ties at the cut vote
        one, both = (sum(s * weight[label[e]] for s, _, e in near if label[e] or c) for c in (0, 1))
        return round((one + X.PRIOR * share) / (both + X.PRIOR), 6)

    steps = X.isotonic([(voted(i), label[i], weight[label[i]]) for i in order])
    return {i: steps[1][max(bisect.bisect_right(steps[0], voted(i)) - 1, 0)] for i, _ in rows}


@pytest.mark.parametrize("max_terms", [X.MAX_TERMS, None])
def test_scores_equal_brute_force(spark, sf, max_terms):
    rows = [(i, (prose(i, 30) if i % 9 else prose(3, 30)) + (" vexor grumblat" if i % 4 == 0 else "") + (" vexorish" if i % 7 == 0 else "")) for i in range(240)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    label = {i: int(i % 4 == 0) for i in range(0, 240, 2) if zlib.crc32(str(i).encode()) % 3 != 1}
    labels = spark.createDataFrame(list(label.items()), "doc_id long, toxic int")
    expected = brute(rows, label, max_terms)
    got = {r["doc_id"]: r["score"] for r in X.score_documents(docs, labels, max_terms).collect()}
    assert got.keys() == expected.keys() and all(abs(got[i] - expected[i]) < 1e-6 for i in got) and len(set(got.values())) > 1
