import random

import pytest
from pyspark.sql import functions as F

from rankloom.operators import blocks as B
from rankloom.operators import index as I
from rankloom.operators import ranking as R

VOCABULARY = [f"w{i}" for i in range(300)]


def corpus(n=3000, seed=1):
    """Documents of unlike lengths; "all" is in each, low words are in many, and there are copies."""
    r = random.Random(seed)
    rows = [(f"d{i}", ["all"] * r.choice((1, 1, 2)) + [VOCABULARY[min(int(r.expovariate(0.03)), 299)] for _ in range(r.randrange(60))]) for i in range(n)]
    return rows + [(f"c{i}", rows[7][1]) for i in range(200)] + [("none", [])]


def queries():
    r = random.Random(2)
    return [(f"q{i}", [VOCABULARY[r.randrange(300)] for _ in range(r.randrange(1, 9))] + ["all", "unknown"] * (i % 2)) for i in range(12)] + [("copy", corpus()[7][1]), ("empty", []), ("off", ["unknown"])]


@pytest.fixture(scope="module")
def ix(spark):
    rows = spark.createDataFrame(corpus(), "doc_id string, tokens array<string>").repartition(3).persist()
    return I.build(rows, I.term_frequencies(rows).persist(), B.pack(rows, 500).persist())


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(queries(), "query_id string, tokens array<string>")


def everything(queries, ix, k1, b):
    """All scores, by a join of all postings."""
    return R.matched(queries, ix).groupBy("query_id", "doc_id").agg(F.sum(R.bm25_weight(F.lit(k1), F.lit(b))).alias("score"))


def rows(df):
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in df.select("query_id", "rank", "doc_id", "score").collect())


@pytest.mark.parametrize("k, k1, b", [(1, 0.9, 0.4), (7, 4.0, 0.75), (100, 0.4, 0.9), (5000, 1.2, 0.0), (10, 0.0, 1.0)])
def test_equals_scoring_all_documents(ix, asked, k, k1, b):
    assert rows(R.bm25(asked, ix, k, k1, b)) == rows(R.top_k(everything(asked, ix, k1, b), k))


def test_waves_and_scans_change_nothing(ix, asked):
    want = rows(R.top_k(everything(asked, ix, 0.9, 0.4), 10))
    for how in ({"wave": 1}, {"wave": 20_000}, {"scan": 20}):
        assert rows(R.top_k(R.scored(asked, ix, [(0.9, 0.4)], 10, **how), 10)) == want


def test_ties_at_the_cut(ix, asked):
    """The copies score alike: the first ids stay, or all of them on request."""
    copy = asked.where("query_id = 'copy'")
    cut, all_ = rows(R.bm25(copy, ix, 20)), rows(R.bm25(copy, ix, 20, ties=True))
    assert len(cut) == 20 and [x[2] for x in cut] == sorted(x[2] for x in cut) and all_[:20] == cut and len(all_) == 201
    assert {x[3] for x in all_} == {cut[0][3]}
    # without lengths, a term alone gives as many scores as it has tfs
    one = asked.limit(1).select("query_id", F.array(F.lit("all")).alias("tokens"))
    n = ix.postings.where("term = 'all' and tf = 2").count()
    assert len(rows(R.bm25(one, ix, 5, 0.9, 0.0, ties=True))) == n > 500 and len(rows(R.bm25(one, ix, 5, 0.9, 0.0))) == 5


def test_blocks_that_cannot_enter_are_not_read(ix, asked):
    asked = asked.where("query_id <> 'copy'")
    told = R.scored(asked, ix, [(0.9, 0.4), (4.0, 0.75)], 3, counts=True).groupBy("setting").agg(F.sum("postings").alias("postings"), F.sum("read").alias("read")).collect()
    all_ = R.matched(asked, ix).count()
    assert len(told) == 2 and all(r["postings"] == all_ and r["read"] < 0.75 * all_ for r in told)


def test_several_settings_at_once(ix, asked):
    settings = [(0.9, 0.4), (4.0, 0.75), (1.2, 0.0)]
    got = R.top_k(R.scored(asked, ix, settings, 5), 5, ("setting", "query_id"))
    for s, (k1, b) in enumerate(settings):
        assert rows(got.where(F.col("setting") == s)) == rows(R.bm25(asked, ix, 5, k1, b))


def test_packed_postings_are_the_postings(ix):
    columns = ["term", "doc_id", "tf", "doc_length"]
    assert sorted(map(tuple, B.unpack(ix.parts).select(columns).collect())) == sorted(map(tuple, ix.postings.select(columns).collect()))


def test_no_task_or_file_holds_a_term(spark, ix, tmp_path):
    """A term that every document has is in many rows of parts, and in many files of a saved index."""
    assert ix.parts.where("term = 'all'").count() == ix.parts.where("term is null").count() >= 7
    ix.save(str(tmp_path), 40)
    loaded = I.load(spark, str(tmp_path))
    n = loaded.postings.count()
    by_file = loaded.postings.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.sum((F.col("term") == "all").cast("int")).alias("all")).collect()
    assert len(by_file) == 40 and max(r["n"] for r in by_file) < 2 * n / 40 and sum(r["all"] > 0 for r in by_file) > 1
    assert sorted(map(tuple, loaded.postings.collect())) == sorted(map(tuple, ix.postings.collect()))


def test_hot_terms_of_a_shuffled_join_are_spread(spark, ix, asked):
    terms = R.query_terms(asked)
    df = ix.term_stats.select("term", "df")
    plain = R.join_terms(ix.postings, terms, df)
    spread = R.join_terms(ix.postings, terms, df, rows=0, together=100)
    columns = ["term", "query_id", "qtf", "doc_id", "tf"]
    assert sorted(map(tuple, spread.select(columns).collect())) == sorted(map(tuple, plain.select(columns).collect()))


def test_saved_index_ranks_alike(spark, ix, asked, tmp_path):
    ix.save(str(tmp_path))
    assert rows(R.bm25(asked, I.load(spark, str(tmp_path)), 10)) == rows(R.bm25(asked, ix, 10))
    assert rows(R.bm25(asked, I.empty(spark), 10)) == []


def test_packing_shuffles_nothing_and_counts_in_slices(spark, monkeypatch):
    """Long documents are not brought together: neither documents nor tokens go to other tasks, and slices of a batch give the same rows."""
    rows = spark.createDataFrame([(d, t + ["runs"] * (i % 3)) for i, (d, t) in enumerate(corpus(300))], "doc_id string, tokens array<string>")
    assert "Exchange" not in B.pack(rows, 50)._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(B, "COUNTED", 40)
    got = {r["doc_id"]: (r["length"], dict(zip(r["terms"], r["tfs"]))) for r in B.counted(rows, "snowball").collect()}
    for r in rows.collect():
        words = ["run" if w == "runs" else w for w in r["tokens"]]
        assert got[r["doc_id"]] == (len(words), {w: words.count(w) for w in words})
    assert B.counted(rows.limit(0)).collect() == []


def test_scores_are_made_where_documents_are(spark, monkeypatch, asked):
    """TF-IDF and sparse runs of counted documents are those of the join of postings, in slices of any size; norms of rare terms come by a join."""
    from rankloom.operators import scan

    plain = spark.createDataFrame(corpus(800), "doc_id string, tokens array<string>").repartition(3).where(F.size("tokens") > 0).persist()
    docs = B.counted(plain).persist()
    kept, ix = I.Counted(docs, B.pack_counted(docs, 100).persist()), I.build(plain)
    norms = lambda df: {r["doc_id"]: round(r["norm"], 9) for r in df.collect()}
    want = norms(ix.doc_norms)
    assert norms(I.norms_by_frequency(kept.postings, kept.term_stats, 50)) == norms(I.norms_by_frequency(kept.postings, kept.term_stats)) == want
    for cells, pairs in ((1_000_000, 1_000_000), (40, 30)):
        monkeypatch.setattr(scan, "CELLS", cells)
        monkeypatch.setattr(scan, "PAIRS", pairs)
        assert rows(R.tfidf(asked, kept, 10)) == rows(R.tfidf(asked, ix, 10)) != []
        weigh = R.query_terms(asked).join(ix.term_stats, "term").select("query_id", "term", (F.log1p("qtf") * F.col("idf")).alias("weight"))
        weights = ix.postings.select("term", "doc_id", F.log1p("tf").alias("weight"))
        assert rows(R.top_k(scan.search(weigh, docs, 10, "log1p", scan=40), 10)) == rows(R.sparse(weigh, weights, 10))
    hits = R.bm25_explain(asked, kept, R.bm25(asked, kept, 5))
    assert hits.groupBy("query_id", "doc_id").count().count() == R.bm25(asked, ix, 5).count()


def test_workers_keep_few_stems(spark):
    """A worker lives on after a task: what it keeps of a vocabulary is bounded."""
    from rankloom.functions import stem

    assert stem.porter2.cache_info().maxsize <= 20_000 and stem.porter.cache_info().maxsize <= 20_000
    assert all(stem.PLAIN[kind](w) == one(w) for kind, one in stem.STEMMERS.items() for w in ("running", "generously", "skies", "flies", "it"))
    rows = spark.createDataFrame([(str(i), ["runs", f"word{i}ing", "running"]) for i in range(50)], "doc_id string, tokens array<string>")

    got = {r["doc_id"]: dict(zip(r["terms"], r["tfs"])) for r in B.counted(rows, "snowball").collect()}
    assert len(got) == 50 and got["7"] == {"run": 2, stem.porter2("word7ing"): 1}


def test_sparse_scan_has_one_worker_a_task(spark, ix, asked):
    from rankloom.operators import scan

    docs = B.counted(spark.createDataFrame(corpus(300), "doc_id string, tokens array<string>"))
    weighted = R.query_terms(asked).select("query_id", "term", F.col("qtf").alias("weight"))
    found = scan.search(weighted, docs, 5, "log1p")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2  # counting, and the scan
    flat = docs.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("doc_id", "p.terms", F.log1p("p.tfs").alias("w"))
    want = flat.join(weighted, F.col("terms") == F.col("term")).groupBy("query_id", "doc_id").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
    assert rows(R.top_k(found, 5)) == rows(R.top_k(want, 5))


@pytest.mark.parametrize("common", [0, 40, 100_000])
def test_norms_where_documents_are(spark, common):
    docs = B.counted(spark.createDataFrame([*corpus(300), ("bare", ["all"])], "doc_id string, tokens array<string>")).persist()
    ix = I.Counted(docs, B.pack_counted(docs))
    want = {r["doc_id"]: r["norm"] for r in I.norms(ix.postings, ix.term_stats).collect()}
    known = I.norms_of_rows(docs, ix.term_stats, common)
    got = {r["doc_id"]: r["norm"] for r in known.collect()}
    assert got.keys() == want.keys() and len(got) > 250 and all(abs(got[i] - want[i]) < 1e-9 for i in got)
    # of frequent terms no row is made
    assert common < 100_000 or I.Counted(docs, ix.parts).doc_norms.count() == len(got)
