import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions import stem, stopwords
from rankloom.functions import text as T
from rankloom.plans import sql as Q

CLEANED = [
    ("Let $x_i$ be the loss [1, 2–3].", "Let   be the loss  .", "Let   be the loss.", ["let", "be", "loss"]),
    ("It costs $5 and the \\alpha rate", "It costs $5 and the   rate", "It costs $5 and the   rate", ["it", "costs", "rate"]),
    ("See https://a.b/c?d=1, and www.x.org now", "See   and   now", "See   and   now", ["see", "now"]),
    ("snake_case x_i GPT4 2024 et al.", "snake_case x_i GPT4 2024 et al.", "snake_case x_i GPT4 2024 et al.", ["snake", "case", "gpt4"]),
    ("tail $y$ ( ) end\n\nnext [12]", "tail   ( ) end\n\nnext  ", "tail     end  next", ["tail", "end", "next"]),
    ("[a1] [1,2] [ 7 ] [3-]", "[a1]     [3-]", "[a1]     [3-]", ["a1"]),
    ("Élan naïve coöperate", "Élan naïve coöperate", "Élan naïve coöperate", ["élan", "naïve", "coöperate"]),
]


def test_cleaning_and_tokens(spark):
    cfg = T.Tokenizing(stopwords=("the", "of", "and", "is", "in", "a", *stopwords.EXTRA), stemming="none")
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(CLEANED)], "i int, t string")
    got = df.select("i", T.clean_text(F.col("t")).alias("c"), T.clean_for_encoder(F.col("t")).alias("e"), T.tokenize(F.col("t"), cfg, T.Cleaning()).alias("k")).orderBy("i").collect()
    for row, (_, clean, encoder, tokens) in zip(got, CLEANED):
        assert (row["c"], row["e"], row["k"]) == (clean, encoder, tokens)


def test_tokens_agree_with_python(spark):
    texts = ["a_b ÀÉ x² 日本 1٣ don't ½ ǅ", "", None, "Straße—naïve… z"]
    cfg = T.Tokenizing(min_token_length=1, drop_numeric=False, stopwords=(), stemming="none")
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(T.tokenize(F.col("t"), cfg).alias("k"), "t").collect()
    for r in rows:
        assert r["k"] == re.findall(r"[^\W_]+", (r["t"] or "").lower())


def test_config_errors():
    for bad in (dict(min_token_length=0), dict(stemming="x")):
        with pytest.raises(ValueError):
            T.Tokenizing(**bad)
    with pytest.raises(ValueError):
        T.Tokenizing.of({"lower": True, "stopwords": {}})
    with pytest.raises(ValueError):
        T.Cleaning.of({"remove_maths": True})
    with pytest.raises(ValueError):
        stopwords.build("other")
    with pytest.raises(ValueError):
        stopwords.build(extra=[1])
    assert stopwords.build("none", ["x"]) == []
    assert "not" not in stopwords.build(keep=["not"]) and "fig" in stopwords.build()


def test_small_functions(spark):
    row = spark.range(1).select(
        T.paper_year(F.lit("2408.00001")).alias("y"), T.truncate(F.lit("one two three"), 9).alias("t"), T.normalize_space(F.lit("  a \n b ")).alias("n"),
        T.highlight(F.lit("Deep learning, deeper"), ["deep", "deep learning"]).alias("h"), T.title_and_text(F.lit(None), F.lit("x")).alias("p"), T.count_words(F.lit(" a b c ")).alias("w"),
    ).first()
    assert (row["y"], row["t"], row["n"], row["h"], row["p"], row["w"]) == (2024, "one two...", "a b", "<mark>Deep learning</mark>, deeper", "x", 3)


def test_stemmers(spark):
    pairs = {"consistency": "consist", "knightly": "knight", "generously": "generous", "hoping": "hope", "hopping": "hop", "skies": "sky", "kiwis": "kiwi", "communication": "communic"}
    assert {w: stem.porter2(w) for w in pairs} == pairs
    old = {"caresses": "caress", "ponies": "poni", "motoring": "motor", "conflated": "conflat", "hissing": "hiss", "triplicate": "triplic", "controll": "control"}
    assert {w: stem.porter(w) for w in old} == old
    rows = spark.createDataFrame([("1", "running"), ("2", "runs"), ("3", "running")], "d string, term string")
    assert sorted(tuple(r) for r in stem.stem_tokens(rows).collect()) == [("1", "run"), ("2", "run"), ("3", "run")]


def test_tokens_are_stemmed_by_default(spark):
    rows = spark.createDataFrame([("Running foxes ran happily",), ("",), (None,), ("x",)], "t string").repartition(1)
    got = {r["t"]: r["k"] for r in rows.select("t", T.tokenize(F.col("t")).alias("k")).collect()}
    assert got == {"Running foxes ran happily": ["run", "fox", "ran", "happili"], "": [], None: [], "x": []}
    nested = rows.select(stem.stem_arrays(F.array(T.words(F.col("t")), F.array(F.lit("skies"))), "snowball", 2).alias("k")).collect()
    assert sorted(r["k"] for r in nested) == sorted([[["run", "fox", "ran", "happili"], ["sky"]]] + 3 * [[[], ["sky"]]])
    sliced = rows.where("t <> ''").select(stem.stem_arrays(F.split("t", " "), "none")).collect()
    assert ["Running", "foxes", "ran", "happily"] in [r[0] for r in sliced]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeioyytlsngdbvrmcué"), min_size=1, max_size=9), st.sampled_from(["", "s", "es", "ed", "ing", "ational", "ization", "fulness", "li", "ative", "ement", "ion", "ogi", "eedly", "ies"]))
def test_stemming_in_sql_is_the_same(a, b):
    import duckdb

    steps = Q.stem_steps("w")
    sql = f"WITH w AS (SELECT '{a + b}' AS term), " + ", ".join(f"{k} AS ({v})" for k, v in steps.items()) + " SELECT s FROM stems"
    assert duckdb.sql(sql).fetchall()[0][0] == stem.porter2(a + b)


def test_many_words_are_marked_as_by_a_pattern(spark):
    """Ten thousand words, in texts with other cases, joined words, signs and accents."""
    import random

    r = random.Random(4)
    words = sorted({"".join(r.choice("abcé") for _ in range(r.randrange(1, 7))) + r.choice(["", " d", "-e", " de f"]) for _ in range(30_000)})[:10_000]
    small = words[::400] + ["c++", "Ärger", "a b c"]
    texts = ["", "x", "ÄRGER c++ a B C", "c++x a b cé"] + ["".join(r.choice(["a", "B", "c", "É", " ", " d", "-e", ".", "9", "de f"]) for _ in range(200)) for _ in range(50)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = df.select("t", T.highlight(F.col("t"), small, few=1000).alias("pattern"), T.highlight(F.col("t"), small, few=0).alias("automaton")).collect()
    assert all(x["pattern"] == x["automaton"] for x in got) and sum("<mark>" in (x["automaton"] or "") for x in got) > 40
    # each step of the automaton is one character, however many words there are
    marker, few = T.Marker(words), T.Marker(words[:10])
    text = " ".join(r.choice(words) for _ in range(2000))
    assert len(marker.spans(text)) > 1000 and marker.spans(text.upper()) == marker.spans(text) and len(few.spans(text)) < 1000
