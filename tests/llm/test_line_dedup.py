import duckdb
from pyspark.sql import functions as F

from rankloom.llm import line_dedup as L

from .conftest import prose


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert sorted(map(tuple, L.op3(spark, sf).collect())) == sorted(c.sql(L.SQL).fetchall())


def documents(spark):
    run = [prose(i, 9) for i in range(10, 16)]  # 54 words on six lines
    single = prose(20, 51)
    texts = [
        "\n".join([prose(30, 12), *run, prose(31, 12)]), "\n".join([prose(32, 5), run[2], prose(33, 30)]), "\n".join([prose(34, 7), *run, prose(35, 40)]),
        "\n".join([single, prose(36, 20)]), "\n\n".join([prose(37, 20), "", single]), "\n".join([run[0], run[1], prose(38, 9)]), "\n".join([single, single, prose(39, 30)]),
    ]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_runs(spark):
    docs = documents(spark)
    got = {r["doc_id"]: r["deleted"] for r in L.summarise(docs).collect()}
    # 0 has the first; 1 shares one short line; 2 repeats the run; 3 has the first single line; 4 repeats it; 5 has 18 words of the run; 6 both
    assert got == {0: "", 1: "", 2: "1,2,3,4,5,6", 3: "", 4: "4", 5: "", 6: "0,1"}
    clean = {r["doc_id"]: r["text"] for r in L.dedup_lines(docs).collect()}
    assert clean[2].count("\n") == 1 and clean[0] == docs.where("doc_id = 0").first()["text"] and clean[4].endswith("\n\n")


def test_windows_of_any_size_equal_sql(spark):
    docs = documents(spark)
    c = duckdb.connect()
    table = docs.toPandas()
    for words in (1, 7, 25, 52, 200):
        c.register("documents", table)
        sql = L.SQL.replace(f"BETWEEN CURRENT ROW AND {L.MIN_WORDS - 1} F", f"BETWEEN CURRENT ROW AND {words - 1} F").replace(f"BETWEEN {L.MIN_WORDS - 1} P", f"BETWEEN {words - 1} P").replace(f">= {L.MIN_WORDS}", f">= {words}")
        assert sorted(map(tuple, L.summarise(docs, words).collect())) == sorted(c.sql(sql).fetchall()), words


def test_odd_rows(odd, none):
    rows = L.summarise(odd).collect()
    assert len(rows) == odd.count() and all(r["n_deleted"] == 0 for r in rows if r["doc_id"] in (2, 3, 5))
    # the text of ids 1 and 8 repeats: the first in order stays
    assert [r["deleted"] for r in rows if r["doc_id"] == 8] == ["0"] and {r["deleted"] for r in rows if r["doc_id"] == 1} == {""}
    out = L.dedup_lines(odd)
    assert out.columns == odd.columns and out.count() == odd.count() and out.where(F.col("text").isNull()).count() == 2
    assert L.summarise(none).count() == 0 and L.dedup_lines(none).count() == 0
