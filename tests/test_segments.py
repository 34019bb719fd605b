import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import index as I
from rankloom.operators import ranking as R
from rankloom.operators.segments import Segments
from rankloom.sources.commits import Change, Log

WORDS = [f"w{i}" for i in range(40)]


def docs(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), "doc_id string, tokens array<string>")


def draw(r, ids):
    return {i: [r.choice(WORDS) for _ in range(r.randrange(0, 12))] for i in ids}


def table(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).collect())


def same(grown: I.Index, built: I.Index, queries):
    for name in ("postings", "doc_stats", "doc_norms", "term_stats", "collection_stats"):
        assert table(getattr(grown, name)) == table(getattr(built, name)), name
    assert table(R.bm25(queries, grown, 10)) == table(R.bm25(queries, built, 10)) and table(R.tfidf(queries, grown, 10)) == table(R.tfidf(queries, built, 10))


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([("a", ["w1", "w2", "w3"]), ("b", ["w9"]), ("c", WORDS), ("d", ["none"])], "query_id string, tokens array<string>")


def test_grown_equals_built_at_once(spark, queries, tmp_path):
    """Batches that replace documents, deletions, and merges on two levels."""
    r, want = random.Random(5), {}
    grown = Segments(spark, str(tmp_path), fan=2)
    for k in range(4):
        batch = draw(r, {f"d{r.randrange(60)}" for _ in range(25)})
        assert grown.append(docs(spark, batch), "feed", k)
        want |= batch
        gone = [i for i in sorted(want) if r.random() < 0.2]
        grown.delete(spark.createDataFrame([(i,) for i in gone + ["unknown"]], "doc_id string"))
        want = {i: t for i, t in want.items() if i not in gone}
    live, marks, done = grown._live()
    assert len(live) == 1 and live[0].level == 2 and done == {"feed": 3}
    same(grown.index(), I.build(docs(spark, want)), queries)
    # the marks of what was merged went with it; what is deleted last is marked
    assert [m.docs for m in marks] == [live[0].docs - len(want)]
    # before a merge, the same with several segments and marks
    loose = Segments(spark, str(tmp_path / "loose"), fan=9)
    for part in (dict(list(want.items())[::2]), {i: ["w1", "old"] for i in list(want)[1::2]}, dict(list(want.items())[1::2])):
        loose.append(docs(spark, part))
    assert len(loose._live()[0]) == 3
    same(loose.index(), I.build(docs(spark, want)), queries)


def test_a_broken_build_goes_on(spark, queries, tmp_path):
    r = random.Random(6)
    batches = [draw(r, [f"{k}-{i}" for i in range(20)]) for k in range(3)]
    grown = Segments(spark, str(tmp_path))
    grown.append(docs(spark, batches[0]), "build", 0, fresh=True)
    # the second batch writes its data and half of its commit
    log = Log(spark, str(tmp_path))
    grown._segment(I.blocks.pack(docs(spark, batches[1])), 0)
    spark.createDataFrame([(1, "half", 2, "add", "lost", 0, 1, 5, 5)], "version long, commit string, rows int, action string, name string, level int, number long, docs long, tokens long").write.json(f"{tmp_path}/log/000000000001-half")
    assert len(grown._live()[0]) == 1 and log.live()[1] == {"build": 0}
    again = Segments(spark, str(tmp_path))
    assert [again.append(docs(spark, b), "build", k, fresh=True) for k, b in enumerate(batches)] == [False, True, True]
    same(again.index(), I.build(docs(spark, batches[0] | batches[1] | batches[2])), queries)


def test_empty(spark, queries, tmp_path):
    grown = Segments(spark, str(tmp_path))
    grown.delete(spark.createDataFrame([("x",)], "doc_id string"))
    assert R.bm25(queries, grown.index()).count() == 0 and grown.index().collection_stats.first()["num_docs"] == 0
    grown.append(docs(spark, {"x": []}))
    assert grown.index().collection_stats.first()["num_docs"] == 1 and R.bm25(queries, grown.index()).count() == 0
    with pytest.raises(ValueError):
        Segments(spark, str(tmp_path), fan=1)


def test_log(spark, tmp_path):
    log = Log(spark, str(tmp_path))
    assert log.live() == ([], {}, -1)
    log.commit([Change("add", "a", 0, 0, 3, 9), Change("done", "s", number=4)])
    log.commit([Change("add", "b", 1, 1, 2, 2), Change("drop", "a"), Change("done", "s", number=2)])
    assert log.live() == ([Change("add", "b", 1, 1, 2, 2)], {"s": 4}, 1)
    assert spark.read.json(f"{tmp_path}/log/*").where(F.col("action") == "drop").count() == 1
