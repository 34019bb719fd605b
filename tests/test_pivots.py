import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankloom.operators import pivots as P
from rankloom.operators import ranking as R

SIZE = 16


def vectors(seed=1, n=3000, spread=0.1):
    """Vectors around some centres, not of unit length, and copies of one."""
    r = np.random.default_rng(seed)
    centers = r.normal(size=(20, SIZE))
    v = centers[r.integers(20, size=n)] + spread * r.normal(size=(n, SIZE))
    v[::10] = v[0]
    return v


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(f"v{i}", x.tolist()) for i, x in enumerate(vectors())], "doc_id string, vector array<double>").repartition(4).persist()


@pytest.fixture(scope="module")
def queries(spark):
    v = vectors()
    r = np.random.default_rng(9)
    rows = [(i, v[i * 50].tolist()) for i in range(20)] + [(90, r.normal(size=SIZE).tolist()), (91, [0.0] * SIZE)]
    return spark.createDataFrame(rows, "query_id long, vector array<double>")


def by_hand(queries, k):
    v = vectors()
    out = []
    for q in queries.collect():
        score = np.round(v @ np.array(q["vector"]), 6) + 0.0
        best = sorted(range(len(v)), key=lambda i: (-score[i], f"v{i}"))[:k]
        out += [(q["query_id"], n + 1, f"v{i}", float(score[i])) for n, i in enumerate(best)]
    return sorted(out)


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 400, 5000])
def test_equals_all_products(table, queries, k):
    got, want = rows(R.dense(queries, table, k)), by_hand(queries, k)
    assert [x[:3] for x in got] == [x[:3] for x in want] and max(abs(a[3] - b[3]) for a, b in zip(got, want)) < 2e-6


def test_chunks_and_scans_change_nothing(table, queries):
    want = rows(R.dense(queries, table, 7))
    for pivots, chunk in ((1, 10_000), (3, 5), (500, 64)):
        assert rows(R.dense(queries, P.pack(table, pivots, chunk), 7)) == want
    assert rows(R.dense(queries, P.pack(table), 7, cells=20)) == want


@pytest.mark.parametrize("k", [500, 700])
def test_many_rows_of_a_query_leave_tasks_once(table, queries, k):
    """Tasks give what all of them together may need, not k rows each."""
    chunks = P.pack(table, 60, 32).repartition(12).persist()
    left = P.search(queries, chunks, k).groupBy("query_id").count().where("query_id <> 91").collect()  # whose scores are all 0
    assert len(left) == 21 and all(k <= r["count"] < 2 * k for r in left)
    got, want = rows(R.dense(queries, chunks, k, cells=3 * k)), by_hand(queries, k)
    assert [x[:3] for x in got] == [x[:3] for x in want] and max(abs(a[3] - b[3]) for a, b in zip(got, want)) < 2e-6


def test_few_vectors_are_multiplied(table, queries):
    near = queries.where("query_id < 90")
    told = P.search(near, P.pack(table, 60, 32).coalesce(1), 5, counts=True).agg(F.sum("vectors").alias("v"), F.sum("multiplied").alias("m")).first()
    assert told["v"] == 20 * 3000 and told["m"] < 0.3 * told["v"]


def test_chunks_are_bounded_and_whole(table):
    chunks = P.pack(table, 60, 32).collect()
    assert sorted(i for c in chunks for i in c["ids"]) == sorted(f"v{i}" for i in range(3000)) and max(len(c["ids"]) for c in chunks) <= 32
    v = vectors()
    for c in random.Random(1).sample(chunks, 20):
        d = np.linalg.norm(v[[int(i[1:]) for i in c["ids"]]] - np.array(c["center"]), axis=1)
        assert c["low"] - 1e-6 <= d.min() and d.max() <= c["high"] + 1e-6


def test_odd_vectors(spark, queries):
    none = spark.createDataFrame([], "doc_id string, vector array<double>")
    assert R.dense(queries, none).count() == 0
    from pyspark.errors import PythonException

    unlike = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "doc_id string, vector array<double>")
    with pytest.raises((ValueError, PythonException)):
        R.dense(queries, unlike).collect()
    short = spark.createDataFrame([("a", [1.0])], "doc_id string, vector array<double>")
    with pytest.raises((ValueError, PythonException)):
        R.dense(queries, short).collect()
