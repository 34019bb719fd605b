import pytest
from pyspark.sql import functions as F

from rankloom.functions import encoders
from rankloom.functions import text as T
from rankloom.operators import index as I
from rankloom.operators import metrics as M
from rankloom.operators import ranking as R
from rankloom.operators import stats as S
from rankloom.operators import tuning as U


@pytest.fixture(scope="module")
def ix(spark):
    return I.build(spark.createDataFrame([("d1", ["a", "a", "b"]), ("d2", ["b", "c"]), ("d3", ["c", "c", "c", "d"])], "doc_id string, tokens array<string>"))


def q(spark, *tokens):
    return spark.createDataFrame([("q", list(tokens))], "query_id string, tokens array<string>")


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.orderBy("rank").collect()}


@pytest.mark.parametrize(
    "k1, b, tokens, expected",
    [
        (0.9, 0.4, "abb", {"d1": 2.225232, "d2": 1.003379}), (0.4, 0.9, "abb", {"d1": 2.084308, "d2": 1.028133}),
        (0.9, 0.4, "cd", {"d3": 1.588985, "d2": 0.501689}), (0.4, 0.9, "cd", {"d3": 1.464195, "d2": 0.514066}), (0.9, 0.4, "z", {}),
    ],
)
def test_bm25(spark, ix, k1, b, tokens, expected):
    assert scores(R.bm25(q(spark, *tokens), ix, 100, k1, b)) == expected


def test_bm25_explain_sums_to_score(spark, ix):
    run = R.bm25(q(spark, "a", "b", "b"), ix)
    parts = R.bm25_explain(q(spark, "a", "b", "b"), ix, run).groupBy("doc_id").agg(F.round(F.sum("part"), 6).alias("score"))
    assert {r["doc_id"]: r["score"] for r in parts.collect()} == scores(run)


def test_tfidf(spark, ix):
    assert {r["doc_id"]: round(r["norm"], 6) for r in ix.doc_norms.collect()} == {"d1": 0.645242, "d2": 0.249031, "d3": 0.543416}
    assert scores(R.tfidf(q(spark, "a", "b", "b"), ix)) == {"d1": 0.985373, "d2": 0.306076}
    assert scores(R.tfidf(q(spark, "c", "d"), ix)) == {"d3": 0.989425, "d2": 0.24483}


def test_bad_parameters(spark, ix):
    for k1, b in ((-1, 0.4), (0.9, 1.1)):
        with pytest.raises(ValueError):
            R.bm25(q(spark, "a"), ix, 10, k1, b)
    with pytest.raises(ValueError):
        R.maxp(R.bm25(q(spark, "a"), ix), k=10, depth=5)
    for page in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            R.page(R.bm25(q(spark, "a"), ix), *page)


def run_of(spark, *docs, query="q"):
    return spark.createDataFrame([(query, d, i + 1, 1.0 / (i + 1)) for i, d in enumerate(docs)], "query_id string, doc_id string, rank int, score double")


def test_rrf_and_maxp(spark):
    fused = R.rrf([run_of(spark, *"xyz"), run_of(spark, *"yw"), run_of(spark, *"zy")])
    assert scores(fused) == {"y": 0.048652, "z": 0.032266, "x": 0.016393, "w": 0.016129}
    swapped = R.rrf([run_of(spark, *"zy"), run_of(spark, *"xyz"), run_of(spark, *"yw")])
    assert scores(swapped) == scores(fused)
    run = spark.createDataFrame([("q", "p1_3", 1, 0.9), ("q", "p2_1", 2, 0.8), ("q", "p1_1", 3, 0.7), ("q", "p3_2", 4, 0.6)], "query_id string, doc_id string, rank int, score double")
    assert scores(R.maxp(run, k=2)) == {"p1": 0.9, "p2": 0.8}


def test_metrics(spark):
    qrels = spark.createDataFrame([("q", "x", 2), ("q", "y", 1), ("q", "u", 1), ("other", "x", 2)], "query_id string, doc_id string, grade int")
    rows = {r["query_id"]: r.asDict() for r in M.per_query(run_of(spark, *"ynxmku"), qrels).collect()}
    r = {k: round(v, 6) for k, v in rows["q"].items() if k != "query_id"}
    assert (r["ndcg"], r["ndcg_at_5"], r["ndcg_exp"], r["ndcg_exp_at_5"]) == (0.752558, 0.638788, 0.691420, 0.605191)
    assert (r["mrr"], r["p_at_5"], r["recall_at_100"]) == (1.0, 0.4, 1.0)
    assert rows["other"]["ndcg"] == 0.0
    s = M.per_query(run_of(spark, *"ynxmku"), M.strict(qrels)).where("query_id = 'q'").first()
    assert (round(s["mrr"], 6), s["p_at_5"]) == (0.333333, 0.2)


def test_t_test():
    # tabulated two-sided critical values
    assert abs(M.t_p_value(2.262157, 10) - 0.05) < 1e-6 and abs(M.t_p_value(-2.085963, 21) - 0.05) < 1e-6 and M.t_p_value(0.0, 5) == 1.0


def test_percentiles(spark):
    ten = spark.range(1, 11).select(F.col("id").alias("n"))
    assert tuple(S.percentiles(ten, "n", {"a": 0.9, "b": 0.0, "c": 0.5}).first()) == (10, 1, 6)
    assert S.median(ten, "n").first()[0] == 5.5


def test_p_values_by_two_ways(spark):
    rows = [(t, n) for n in (2, 3, 4, 5, 10, 21, 50, 201) for t in (0.1, 1.0, 2.262157, 5.0)]
    got = spark.createDataFrame(rows, "t double, n long").select("t", "n", M.student_p(F.col("t"), F.col("n")).alias("p")).collect()
    assert all(abs(r["p"] - M.t_p_value(r["t"], r["n"])) < 1e-9 for r in got)
    assert spark.range(1).select(M.student_p(F.lit(None).cast("double"), F.lit(5))).first()[0] == 1.0


def scored(spark):
    rows = [(m, f"q{i}", x) for i in range(40) for m, x in (("a", 0.5 + i % 7 / 20), ("b", 0.2 + i % 5 / 20), ("c", 0.2 + i % 5 / 20))]
    return spark.createDataFrame(rows, "model string, query_id string, ndcg double")


def test_significance(spark):
    for name, test in M.TESTS.items():
        p = {(r["model_a"], r["model_b"]): r["p"] for r in test(scored(spark), "ndcg").collect()}
        assert p["a", "b"] < 0.01 and p["a", "c"] < 0.01 and p["b", "c"] > 0.9, name
    assert M.display_name("rrf:bm25+sparse") == "RRF(BM25+SPLADE)" and M.display_name("own") == "own"
    names = spark.createDataFrame([("rrf:bm25+own",), ("tfidf",)], "m string").select(M.display_names(F.col("m")))
    assert [r[0] for r in names.collect()] == ["RRF(BM25+own)", "TF-IDF"]


def test_rankers_and_numbers(spark):
    docs = spark.createDataFrame([("d1", "running fish"), ("d2", "a red fish swims"), ("d3", "blue sky")], "doc_id string, text string")
    ix = I.build(docs.select("doc_id", T.tokenize(F.col("text")).alias("tokens")))
    for ranker in (R.Bm25(ix), R.TfIdf(ix)):
        assert [d for d, _ in ranker.search("runs fishes")] == ["d1", "d2"] and ranker.search("zzz") == []
    with pytest.raises(ValueError):
        R.Bm25(ix).set_params(1.0, 2.0)
    vectors = encoders.encode(docs).select("doc_id", "vector")
    assert R.Dense(vectors, encoders.HashEncoder).search("blue sky", 1)[0][0] == "d3"
    assert ix.doc_number("d2") == 1 and ix.doc_id(2) == "d3" and [r["doc_id"] for r in ix.term_postings("fish").collect()] == ["d1", "d2"] and ix.term_postings("zzz").count() == 0
    with pytest.raises(KeyError):
        ix.doc_number("d9")
    with pytest.raises(IndexError):
        ix.doc_id(3)
    assert I.empty(spark).collection_stats.first()["num_docs"] == 0


def test_blocks_of_postings(spark):
    rows = spark.createDataFrame([(f"d{i:03d}", ["x", "y"] if i % 50 else ["x"]) for i in range(200)], "doc_id string, tokens array<string>")
    ix = I.build(rows)
    lists = I.postings_lists(ix.postings, ix.term_stats, block=16).collect()
    assert max(len(r["docs"]) for r in lists) < 60 and all(r["docs"] == sorted(r["docs"]) for r in lists)
    assert sorted(d for r in lists if r["term"] == "x" for d in r["docs"]) == [f"d{i:03d}" for i in range(200)]


def test_grid_equals_single_runs(spark, ix):
    qrels = spark.createDataFrame([("q", "d1", 1), ("q", "d2", 2)], "query_id string, doc_id string, grade int")
    queries = q(spark, "a", "b", "b", "c")
    cells = [(0.9, 0.4), (0.4, 0.9)]
    got = {(r["k1"], r["b"]): r["ndcg_at_5"] for r in U.bm25_grid(queries, ix, qrels, cells).collect()}
    for k1, b in cells:
        assert abs(got[k1, b] - M.per_query(R.bm25(queries, ix, 100, k1, b), qrels).first()["ndcg_at_5"]) < 1e-9
    split = U.tuning_sample(spark.createDataFrame([(str(i),) for i in range(50)], "query_id string"), n=20)
    assert split.count() == 20 and split.where("held_out").count() == 4


def test_maxp_refuses_unknown_paragraphs(spark):
    run = spark.createDataFrame([("q", "p1_3", 1, 0.9), ("q", "p2_1", 2, 0.8)], "query_id string, doc_id string, rank int, score double")
    table = spark.createDataFrame([("p1_3", "p1")], "doc_id string, paper_id string")
    with pytest.raises(Exception, match="no paper for paragraph p2_1"):
        R.maxp(run, table, k=2).collect()


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    few = spark.createDataFrame([("x" * 1000,)] * 5, "t string")
    assert hinted(R.small(few)) and not hinted(R.small(few, rows=4)) and not hinted(R.small(few, most=4000))


def test_dense_in_blocks(spark):
    v = spark.createDataFrame([(str(i), [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "doc_id string, vector array<float>")
    queries = v.select(F.col("doc_id").alias("query_id"), "vector").where("cast(doc_id as int) < 9")
    one, many = R.dense(queries, v, 5), R.dense(queries, v, 5, cells=10)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect())) and one.count() == 45


def test_triples_without_negatives_and_cycling(spark):
    ex = spark.createDataFrame([("1", "q1", "Easy", {"a": 2, "b": 1, "c": 1}, ["x", "y"]), ("2", "q2", "Easy", {"a": 1}, [])], "query_id string, query string, label string, positives map<string,int>, negatives array<string>")
    texts = spark.createDataFrame([(c, c.upper()) for c in "abcxy"], "doc_id string, text string")
    assert sorted((r["positive"], r["negative"]) for r in U.training_triples(ex, texts).collect()) == [("A", "X"), ("B", "Y"), ("C", "X")]


def test_best_checkpoint(spark):
    log = spark.createDataFrame([(50, 0.1), (100, 0.4), (150, 0.3), (200, 0.4), (250, 0.2), (300, 0.9)], "step long, value double")
    assert tuple(U.best_checkpoint(log, 3).first()) == (100, 0.4, 250)
    assert tuple(U.best_checkpoint(log, 9).first()) == (300, 0.9, None)


def test_numbers_come_from_ranges_that_are_drawn_once(spark):
    """Ranges are sampled and joined as sizes ask: their numbers are stored, not made for the counts and for the places."""
    from rankloom.operators.index import numbered
    from rankloom.sources.readers import batches

    ids = spark.range(6_000).select(F.col("id").cast("string").alias("doc_id"), F.lit("x").alias("text")).repartition(3)
    place = {d: i for i, d in enumerate(sorted(map(str, range(6_000))))}
    for got, by, size in ((numbered(ids, "doc_id"), "number", 1), (batches(ids), "batch", 256)):
        assert "SPARK_PARTITION_ID" not in got._jdf.queryExecution().optimizedPlan().toString()
        assert all(r[by] == place[r["doc_id"]] // size for r in got.collect())


def test_metrics_of_models_bring_together_only_judgements_of_their_rows(spark):
    qrels = spark.createDataFrame([(q, f"d{i}", 1 + i % 2) for q in "xy" for i in range(300)] + [("z", "d0", 0)], "query_id string, doc_id string, grade int")
    run = spark.createDataFrame([(m, q, f"d{i}", i + 1) for m, q in (("a", "x"), ("a", "w"), ("b", "y")) for i in range(3)], "model string, query_id string, doc_id string, rank int")
    together = M.by_model(run, qrels, ["a", "b"])
    got = {(r["model"], r["query_id"]): r.asDict() for r in together.collect()}
    assert set(got) == {(m, q) for m in "ab" for q in "xyz"}
    for m in "ab":
        for r in M.per_query(run.where(f"model = '{m}'").drop("model"), qrels).collect():
            assert got[m, r["query_id"]] == {"model": m} | r.asDict()
    assert got["a", "x"]["recall_at_100"] == 0.01 and got["b", "x"]["ndcg"] == 0 == got["a", "z"]["ndcg"]
    # judgements are not multiplied by the models: only the few rows of queries are
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and plan.count("WindowGroupLimit") == 1


def test_maxp_brings_together_only_paragraphs_of_the_run(spark):
    run = spark.createDataFrame([("q", "a_1", 0.9, 1), ("q", "b_1", 0.8, 2)], "query_id string, doc_id string, score double, rank int")
    table = spark.createDataFrame([(f"{p}_{i}", p) for p in "abc" for i in range(50)], "doc_id string, paper_id string")
    got = R.maxp(run, table, k=2)
    assert scores(got) == {"a": 0.9, "b": 0.8}
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()


def test_manifest_counts_what_examples_list(spark):
    """Counts come without a row that holds all documents of a query."""
    from rankloom.operators import tuning as U

    queries = spark.createDataFrame([(f"q{i}", f"text {i}", "Easy" if i % 2 else "Hard") for i in range(8)], "query_id string, query string, label string")
    judged = [(f"q{q}", f"d{i}", i % 3) for q in range(6) for i in range(q * 9)] + [("q7", "d1", 0), ("other", "d1", 2)]
    qrels = spark.createDataFrame(judged, "query_id string, doc_id string, grade int")
    run = spark.createDataFrame([(f"q{q}", f"d{i * 2}", i + 1) for q in range(8) for i in range(60)], "query_id string, doc_id string, rank int")
    there = spark.createDataFrame([(f"d{i}",) for i in range(110)], "doc_id string")
    splits = U.stratified_split(queries.select("query_id", "label"), 0.3)
    for n, collection in ((30, None), (5, there)):
        want = U.manifest(U.training_examples(queries, qrels, run, n, collection=collection), splits)
        got = U.manifest_of(queries, splits, qrels, run, n, collection=collection)
        assert sorted(got.collect()) == sorted(want.collect()) and got.count()
        assert "collect_list" not in got._jdf.queryExecution().toString()


def test_triples_of_rows_are_triples_of_examples_and_shuffle_no_text_per_row(spark):
    """A positive's text is shuffled once for its document, whatever the number of queries; the negatives are sent."""
    from rankloom.operators import tuning as U

    queries = spark.createDataFrame([(f"q{i}", f"text {i}", "Easy") for i in range(9)], "query_id string, query string, label string")
    judged = [(f"q{q}", f"d{i}", i % 3) for q in range(7) for i in range(q * 9)] + [("q7", "d1", 0), ("q8", "d1", 1), ("other", "d1", 2)]
    qrels = spark.createDataFrame(judged, "query_id string, doc_id string, grade int")
    run = spark.createDataFrame([(f"q{q}", f"d{i * 2}", i + 1) for q in range(8) for i in range(60)], "query_id string, doc_id string, rank int")
    there = spark.createDataFrame([(f"d{i}",) for i in range(110)], "doc_id string")
    texts = spark.createDataFrame([(f"d{i}", f"body {i}") for i in range(130)], "doc_id string, text string")
    for n, collection in ((30, None), (5, there)):
        # by hand, from the lists of the examples
        want = []
        for r in U.training_examples(queries, qrels, run, n, collection=collection).collect():
            neg, body = r["negatives"], lambda d: "body " + d[1:]
            want += [(r["query_id"], r["query"], body(d), body(neg[i % len(neg)])) for i, d in enumerate(sorted(r["positives"])) if neg]
        got = U.triples_of(queries, qrels, run, texts, n, collection=collection)
        assert sorted(map(tuple, got.collect())) == sorted(want) and want
    examples = U.training_examples(queries, qrels, run)
    assert sorted(map(tuple, U.training_triples(examples, texts).collect())) == sorted(map(tuple, U.triples_of(queries, qrels, run, texts).collect()))
    # even where no table is broadcast by its size, no exchange takes rows that have a positive's text already
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for got in (U.triples_of(queries, qrels, run, texts), U.training_triples(examples, texts)):
            plan = got._jdf.queryExecution().sparkPlan()
            joins = [line for line in plan.toString().splitlines() if "Join" in line]
            above = [line for line in joins if "neg_id" in line]
            assert len(above) == 1 and "BroadcastHashJoin" in above[0]
            assert "collect_list" not in plan.toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_places_inside_groups(spark):
    from rankloom.operators.index import numbered_within

    rows = spark.createDataFrame([(g, f"{i:04d}", "x") for g, n in (("a", 3_000), ("b", 1), ("c", 500)) for i in range(n)], "g string, doc_id string, text string").repartition(5)
    got = numbered_within(rows, "g", "doc_id")
    assert got.columns == ["g", "doc_id", "text", "number"] and got.count() == 3_501
    assert all(r["number"] == int(r["doc_id"]) for r in got.collect())
