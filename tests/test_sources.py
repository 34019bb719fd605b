import json

import pytest

from rankloom.operators import collections as C
from rankloom.operators import index as I
from rankloom.sources import readers as S
from rankloom.sources import writers as W
from rankloom.operators.segments import Segments
from rankloom.streaming import incremental


def test_raw_papers_to_collections(spark, tmp_path):
    d = tmp_path / "papers"
    d.mkdir()
    (d / "a.json").write_text(json.dumps({"paper_id": "2401.00001", "title": "Deep nets", "abstract": "", "paragraphs": {"2401.00001_2": "second graph", "2401.00001_10": "tenth", "2401.00001_1": "first text", "2401.00001_3": "1 2"}}))
    (d / "b.json").write_text("{not json")
    (d / "c.json").write_text(json.dumps({"paper_id": "2402.00002", "title": None, "abstract": "abs", "paragraphs": {"2402.00002_1": "5"}}))
    papers, bad = S.raw_papers(spark, str(d))
    assert papers.count() == 2 and bad.count() == 1
    assert S.raw_papers(spark, str(d), 1)[0].count() == 1 and S.raw_papers(spark, str(d), 0)[0].count() == 2
    whole, parts = C.paper_collection(papers, title_weight=2)
    row = whole.collect()
    assert len(row) == 1 and row[0]["tokens"] == ["deep", "net", "deep", "net", "first", "text", "second", "graph", "tenth"] and row[0]["year"] == 2024
    assert parts.count() == 3
    titled = C.paper_collection(papers, paragraph_title=True)[1].where("doc_id = '2401.00001_10'").first()
    assert titled["tokens"] == ["deep", "net", "tenth"]


def test_queries(spark, tmp_path):
    def read(text):
        (tmp_path / "q.json").write_text(text)
        return S.queries(spark, str(tmp_path / "q.json"))

    assert read('[{"query_id": 1, "query": "a b"}, {"query_id": "2", "query": "c", "label": "Easy"}]').count() == 2
    for bad in ('{"query_id": 1}', '[{"query_id": 1}]', '[{"query_id": 1, "query": "a"}, {"query_id": "1", "query": "b"}]'):
        with pytest.raises(S.InputError):
            read(bad)


def test_runs_and_qrels(spark, tmp_path):
    (tmp_path / "qrels").write_text("q1 0  d1\t2\n\nq1 0 d2 0\nq1 0 d2 1\n")
    assert sorted(map(tuple, S.qrels(spark, str(tmp_path / "qrels")).collect())) == [("q1", "d1", 2), ("q1", "d2", 1)]
    run = spark.createDataFrame([("q1", "d1", 1, 0.5), ("q1", "d2", 2, 0.25)], "query_id string, doc_id string, rank int, score double")
    W.write_run(run, str(tmp_path / "run"), "bm25")
    back = S.run(spark, str(tmp_path / "run"))
    assert sorted(map(tuple, back.collect())) == [("q1", "d1", 1, 0.5, "bm25"), ("q1", "d2", 2, 0.25, "bm25")]
    with pytest.raises(S.InputError):
        W.write_run(run.withColumn("score", run["rank"] * 1.0), str(tmp_path / "bad"), "bm25")
    with pytest.raises(S.InputError):
        W.write_run(run, str(tmp_path / "bad"), "b m")
    with pytest.raises(S.InputError):
        W.run_name("book", "bm25", "train")
    assert W.run_name("paper", "bm25", "study") == "paper_bm25_study"


def test_missing_text(spark):
    texts = spark.createDataFrame([("a", "x")], "doc_id string, text string")
    assert S.texts_of(texts, texts).count() == 1
    with pytest.raises(S.InputError):
        S.texts_of(texts, spark.createDataFrame([("b",)], "doc_id string"))


def test_index_tables_and_resumed_build(spark, tmp_path):
    rows = spark.createDataFrame([("a", ["x", "y"]), ("b", ["x"])], "doc_id string, tokens array<string>")
    ix = I.load_or_build(spark, str(tmp_path / "ix"), rows)
    assert ix.term_stats.where("term = 'x'").first()["df"] == 2 and ix.collection_stats.first()["avg_doc_length"] == 1.5
    assert I.load_or_build(spark, str(tmp_path / "ix"), rows.limit(0)).postings.count() == 3
    assert I.build(rows.limit(0)).collection_stats.first()["avg_doc_length"] == 0.0
    assert W.append_new(rows, str(tmp_path / "enc")) == 2
    more = rows.union(spark.createDataFrame([("c", ["z"])], rows.schema))
    assert W.append_new(more, str(tmp_path / "enc")) == 1 and spark.read.parquet(str(tmp_path / "enc")).count() == 3


def test_checkpoints_and_grid(spark):
    paths = spark.createDataFrame([("run/checkpoint-50",), ("run/checkpoint-200",), ("run/final",)], "path string")
    assert S.latest_checkpoint(paths).first()["path"] == "run/checkpoint-200"
    grid = spark.createDataFrame([(0.6, 0.2, 0.5), (0.6, 0.4, 0.6), (0.9, 0.2, 0.7)], "k1 double, b double, v double")
    assert [tuple(r) for r in S.grid_matrix(grid, "v").collect()] == [(0.6, 0.5, 0.6), (0.9, 0.7, None)]


def test_stream_index_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([("a", "alpha beta alpha"), ("b", "beta gamma")], "doc_id string, text string")
    docs.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = incremental.documents(spark, str(tmp_path / "in"), "doc_id string, text string", files=1)
    incremental.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = Segments(spark, str(tmp_path / "out")).index().postings.select("term", "doc_id", "tf")
    assert sorted(map(tuple, got.collect())) == [("alpha", "a", 2), ("beta", "a", 1), ("beta", "b", 1), ("gamma", "b", 1)]


def test_settings_without_a_yaml_library():
    import yaml

    from rankloom.plans import storage

    for text in (storage.PREPROCESSING, storage.BM25, "a: 1\nb:\n  c: x # y\n  d: [1, 'two']\n", ""):
        assert S.plain_settings(text) == (yaml.safe_load(text) or {})
    with pytest.raises(S.InputError):
        S.plain_settings("- a\n- b")


def test_lookup_opens_only_the_files_of_wanted_ids(spark, tmp_path):
    from rankloom.sources import lookup

    rows = spark.range(3000).selectExpr("printf('%05d', id) as doc_id", "concat('text ', id) as text").union(spark.createDataFrame([("01500", "again")], "doc_id string, text string"))
    lookup.save(rows, str(tmp_path / "t"), files=25)
    table = lookup.Lookup(spark, str(tmp_path / "t"))
    assert len(table.files) == 25
    got = table.rows(["00007", "01500", "02999", "00007"])
    assert sorted(r["doc_id"] for r in got.collect()) == ["00007", "01500", "01500", "02999"] and len(got.inputFiles()) <= 4
    with pytest.raises(S.InputError):
        table.rows(["00007", "9"])
    assert table.rows(["00007", "9"], missing=True).count() == 1 and table.rows(["zzz"], missing=True).count() == 0 and table.rows([]).count() == 0


def test_raw_papers_of_many_to_a_file(spark, tmp_path):
    """An object a line, malformed ones among them; a paper's tokens are made without a shuffle."""
    papers = [json.dumps({"paper_id": f"2401.{i}", "title": "Deep nets", "abstract": "", "paragraphs": {f"2401.{i}_2": "second graph", f"2401.{i}_1": "first text"}}) for i in range(30)]
    (tmp_path / "all.json").write_text("\n".join([*papers, '{"paper_id": "2401.30", ', "{not json"]))
    good, bad = S.raw_papers(spark, str(tmp_path), lines=True)
    assert good.count() == 30 and bad.count() == 2
    whole, _ = C.paper_collection(good, title_weight=2)
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()
    assert [r["tokens"] for r in whole.collect()] == [["deep", "net", "deep", "net", "first", "text", "second", "graph"]] * 30


def test_input_checks_hold_every_check(spark):
    """The query reports all of what must be refused and what must not."""
    from rankloom.plans import catalog, storage

    sql = catalog.oracle_sql()["input_checks"]
    assert all(f"'{name}'" in sql for name in storage._NAMES) and len(storage._NAMES) == 31
