import duckdb
import pytest

from rankloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def test_every_query_has_sql_that_runs(duck):
    sql = catalog.oracle_sql()
    assert set(sql) == set(catalog.queries()) and all(isinstance(s, str) for s in sql.values())
    for name, s in sql.items():
        assert duck.sql(s).columns, name


def same(x):
    return repr(round(x, 6) + 0.0) if isinstance(x, float) else "[" + ",".join(map(same, x)) + "]" if isinstance(x, (list, tuple)) else str(x)


@pytest.mark.parametrize("name", ["tokenize", "bm25_papers", "tfidf_paragraphs", "dense_topk", "evaluation_report", "significance", "significance_tukey", "bm25_grid", "tuning_sample", "excerpt", "postings_lists", "run_round_trip", "saved_sparse_index", "input_checks", "bm25_ties", "packed_postings", "window_weights", "dense_ranker", "search_facets_page", "highlight_vocabulary", "looked_up_texts", "page_buttons"])
def test_rows_equal_those_of_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.sql(catalog.oracle_sql()[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    expected = sorted(tuple(same(r[i]) for i in at) for r in found.fetchall())
    assert sorted(tuple(same(r[c]) for c in cols) for r in df.collect()) == expected and expected


def test_what_must_be_refused_and_what_must_not(spark):
    from rankloom.plans import storage

    got = storage._checks(spark, SF)
    assert [n for n, _ in got] == list(storage._NAMES) and all(error == (name not in storage._RIGHT) for name, error in got)
