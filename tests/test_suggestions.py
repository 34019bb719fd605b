import random

import pytest

from rankloom.operators import serving as V
from rankloom.operators import suggestions as G


@pytest.fixture(scope="module")
def titles(spark):
    r = random.Random(3)
    words = ["Graph", "neural", "ÉCOLE", "a", "search", "of", "re-ranking", "x" * 30, "ßtraße", "100%"]
    rows = [(n, " ".join(r.choice(words) for _ in range(r.randrange(0, 6)))) for n in range(500)] + [(500, None), (777, "last GRAPH")]
    return spark.createDataFrame(rows, "number long, title string").repartition(3).persist()


@pytest.fixture(scope="module")
def indexes(titles):
    out = {b: G.build(titles, b) for b in (16, 1000)}
    for index in out.values():
        index.grams = index.grams.persist()
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("text", ["graph", " Re", "a", "école", "last graph", "nothing here", " "])
def test_equals_a_scan(titles, indexes, text):
    index = indexes[16]
    for n, prefix in ((5, False), (5, True), (600, False)):
        assert rows(index.suggest(text, n, prefix)) == rows(V.suggest(titles, text, n, prefix)), (text, prefix, n)
    assert rows(indexes[1000].suggest(text)) == rows(V.suggest(titles, text))


def test_no_list_is_longer_than_a_block(titles, indexes, spark, tmp_path):
    index = indexes[16]
    lists = index.grams.collect()
    assert max(len(r["numbers"]) for r in lists) <= 16 and all(n // 16 == r["block"] for r in lists for n in r["numbers"])
    index.save(str(tmp_path))
    assert rows(G.load(spark, str(tmp_path), 16).suggest("search")) == rows(V.suggest(titles, "search"))


def test_search_ends_early(titles):
    """Titles after the blocks that have enough are not read: they may be broken."""
    from pyspark.sql import functions as F

    index = G.build(titles, 16)
    late = F.when(F.col("number") >= 16 * G.FIRST_BLOCKS, F.raise_error(F.lit("read too far")).cast("string")).otherwise(F.col("title"))
    index.titles = index.titles.withColumn("title", late)
    assert rows(index.suggest("search")) == rows(V.suggest(titles, "search"))
