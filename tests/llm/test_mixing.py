from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from rankloom.llm import mixing as M


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    cols = ["doc_id", "size", "source_size", "target", "taken"]
    got = sorted(map(tuple, M.op4(spark, sf).select(*cols).collect()))
    assert got == sorted(c.sql(f"select {', '.join(cols)} from ({M.SQL})").fetchall())


def water(sizes, weights):
    """Shares a budget by weight under caps, in rounds."""
    total, names, target, open_ = sum(sizes), range(len(sizes)), {}, set(range(len(sizes)))
    while open_:
        left = total - sum(target.values())
        level = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if level * weights[i] > 3 * sizes[i]}
        if not over:
            target |= {i: level * weights[i] for i in open_}
            break
        target |= {i: 3.0 * sizes[i] for i in over}
        open_ -= over
    return [target.get(i, 0.0) for i in names]


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 500, 3, 2, 900, 10_000], [0, 0, 0], [0, 5, 7], [7], [1, 1, 1, 1000]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r["source"]: r["target"] for r in M.targets(df).collect()}
    expected = water(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))])
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(expected)


@pytest.mark.parametrize("block", [1, 7, 1024])
def test_words_taken(odd, block):
    rows = M.mix_documents(odd, block_words=block).collect()
    assert len(rows) == odd.count() and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    # sources of one size may share a target
    sizes, by = Counter(), {}
    for r in odd.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    for r in rows:
        by.setdefault((r["source_size"], r["target"]), []).append(r["taken"])
    shared = Counter(sizes.values())
    assert all(abs(sum(t) - target * n) <= n for (size, target), t in by.items() for n in range(1, shared[size] + 1) if target and len({x for x in by if x[0] == size}) * n == shared[size])
    assert sum(r["taken"] for r in rows) == pytest.approx(sum(sizes.values()), abs=len(sizes))
    again = M.mix_documents(odd, block_words=block).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_schedule_is_mixed_from_the_start(spark):
    plan = spark.createDataFrame([("a", 5000, 5000.0, 5000, 500), ("b", 2000, 2000.0, 2000, 200), ("c", 1000, 1000.0, 1000, 100)], "source string, source_size long, target double, goal long, need long")
    slots = M.schedule(plan, 10)
    assert slots.count() == 800 and slots.select("source", "rank").distinct().count() == 800
    first = {r["source"]: r["n"] for r in slots.where("i < 80").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert abs(first["a"] - 50) <= 3 and abs(first["b"] - 20) <= 3 and abs(first["c"] - 10) <= 3


def test_mixed_rows(odd, none):
    out = M.mixed(odd)
    assert out.columns == odd.columns
    taken = {(r["doc_id"], r["size"], r["taken"]) for r in M.mix_documents(odd).collect()}
    assert out.where("doc_id = 4").count() == next(int(t / s + 0.5) for d, s, t in taken if d == 4)
    assert out.where("text is null or trim(text) = ''").count() == 0
    assert M.mix_documents(none).count() == 0 and M.mixed(none).count() == 0
