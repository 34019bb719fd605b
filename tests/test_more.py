import pytest
from pyspark.sql import functions as F

from rankloom.functions import encoders
from rankloom.operators import ranking as R
from rankloom.operators import serving as V
from rankloom.operators import tuning as U
from rankloom.sources import readers as S
from rankloom.sources import writers as W


def test_encoders(spark):
    docs = spark.createDataFrame([("a", "red fish"), ("b", "red fish"), ("c", None)], "doc_id string, text string")
    v = {r["doc_id"]: r["vector"] for r in encoders.encode(docs).collect()}
    assert v["a"] == v["b"] and abs(sum(x * x for x in v["a"]) - 1) < 1e-6 and set(v["c"]) == {0.0}
    assert R.max_pool(encoders.logits(docs)).where("doc_id = 'c'").count() == 0


def test_batches(spark, tmp_path):
    rows = spark.createDataFrame([(f"{i:03d}", "x" if i % 10 else " ") for i in range(100)], "doc_id string, text string")
    got = S.batches(rows, 7).collect()
    assert [r["batch"] for r in sorted(got)] == [i // 7 for i in range(90)]
    assert S.batches(rows, 7, 0).count() == 0 and S.batches(rows, 7, 8).count() == 8
    with pytest.raises(ValueError):
        S.batches(rows, 0)
    assert S.manifest_count(spark, str(tmp_path / "none")) is None
    W.write_jsonl(spark.createDataFrame([(3,)], "paragraphs int"), str(tmp_path / "m"))
    assert S.manifest_count(spark, str(tmp_path / "m")) == 3


def test_pages_and_saved(spark):
    assert V.page_buttons(1, 9) == [1, 2, 3, 4, 5] and V.page_buttons(9, 9) == [5, 6, 7, 8, 9] and V.page_buttons(5, 9) == [3, 4, 5, 6, 7] and V.page_buttons(1, 2) == [1, 2]
    assert V.active_filters(["a", "b"], 2020) == 3 and V.active_filters(None, None) == 0
    saved = spark.createDataFrame([("Mine", "d1", "paper", 1)], "name string, doc_id string, collection string, saved_at int")
    new = spark.createDataFrame([(" mine", "d1", "paper", 2), ("mine", "d2", "paper", 3)], saved.schema)
    assert sorted(r["saved_at"] for r in V.save_document(saved, new).collect()) == [2, 3]


def test_suggest_and_vocabulary(spark):
    titles = spark.createDataFrame([(1, "On Red fish"), (2, "red"), (3, "blue")], "number int, title string")
    assert [r["number"] for r in V.suggest(titles, " RED ").collect()] == [1, 2]
    assert [r["number"] for r in V.suggest(titles, "red", prefix_first=True).collect()] == [2, 1]
    assert V.suggest(titles, "  ").count() == 0
    q = spark.createDataFrame([("1", "The Red  fish, red fish, 5")], "query_id string, query string")
    assert [r["word"] for r in V.query_vocabulary(q).orderBy("pos").collect()] == ["Red", "fish,", "red"]
    state = spark.createDataFrame([("RED", False)], "word string, active boolean")
    words = V.query_vocabulary(q).select("word")
    assert {r["word"]: r["active"] for r in V.merge_vocabulary(words, state).collect()} == {"Red": False, "red": False, "fish,": True}


def test_curve(spark):
    log = spark.createDataFrame([(50, 0.2), (100, None)], "step long, value double")
    assert [tuple(r) for r in U.curve(log, 0.1).collect()] == [(0, 0.1), (50, 0.2)]
    assert U.metric_column(["loss", "eval_x_cosine_ndcg@10"]) == "eval_x_cosine_ndcg@10"
    with pytest.raises(KeyError):
        U.metric_column(["loss"])


def test_hard_negatives_are_below_the_top_and_unjudged(spark):
    run = spark.createDataFrame([("q", f"d{i}", i) for i in range(1, 61)], "query_id string, doc_id string, rank int")
    qrels = spark.createDataFrame([("q", "d30", 2)], "query_id string, doc_id string, grade int")
    got = U.hard_negatives(run, qrels, 10).collect()
    assert len(got) == 10 and all(int(r["doc_id"][1:]) > 20 and r["doc_id"] != "d30" for r in got)
    assert sorted(got) == sorted(U.hard_negatives(run.orderBy(F.rand(1)), qrels, 10).collect())
    with pytest.raises(ValueError):
        U.stratified_split(run, 1.0)


def test_windows_hold_every_word(spark):
    words = [f"w{i}" for i in range(1000)]
    docs = spark.createDataFrame([("long", " \n".join(words)), ("edge", " ".join(words[:256])), ("short", " a  b "), ("none", None), ("blank", " ")], "doc_id string, text string")
    got = {}
    for r in encoders.windows(docs).orderBy("doc_id", "window").collect():
        got.setdefault(r["doc_id"], []).append(r["text"].split())
    assert [len(got[d]) for d in ("long", "edge", "short", "none", "blank")] == [5, 1, 1, 1, 1] and got["short"] == [["a", "b"]] and got["none"] == [[]]
    assert all(len(w) <= encoders.WINDOW for w in got["long"]) and {x for w in got["long"] for x in w} == set(words) and got["long"][1] == words[192:448]
    # the last word of a long text counts
    cut = lambda: encoders.HashEncoder(max_words=encoders.WINDOW)
    one, other = (spark.createDataFrame([("d", " ".join(words + [w]))], "doc_id string, text string") for w in ("x", "y"))
    weights = lambda df: sorted(map(tuple, R.max_pool(encoders.window_logits(df, cut)).collect()))
    assert weights(one) != weights(other) and sorted(map(tuple, R.max_pool(encoders.logits(one, cut)).collect())) == sorted(map(tuple, R.max_pool(encoders.logits(other, cut)).collect()))
    with pytest.raises(ValueError):
        encoders.windows(docs, size=10, stride=11)


def test_parts_are_made_once_and_a_broken_build_goes_on(spark, tmp_path):
    path, made = str(tmp_path / "t"), []
    rows = spark.createDataFrame([(f"{i}", float(i)) for i in range(50)], "doc_id string, x double")

    def make(part):
        made.append(part.count())
        if len(made) == 4:
            raise RuntimeError("power cut")
        return part.withColumn("x", F.col("x") * 2)

    with pytest.raises(S.InputError):
        W.grown(spark, path)
    with pytest.raises(RuntimeError):
        W.append_in_parts(rows, path, make, every=5)
    kept = W.grown(spark, path).count()
    assert kept == sum(made[:3]) < 50
    assert W.append_in_parts(rows, path, make, every=5) == 50 - kept and W.append_in_parts(rows, path, make, every=5) == 0
    assert sorted(map(tuple, W.grown(spark, path).collect())) == sorted((f"{i}", 2.0 * i) for i in range(50)) and sum(made) == 50 + made[3]


def test_each_text_with_a_word_has_a_vector_of_length_one():
    """Also if its words cancel out."""
    one = lambda text: encoders.HashEncoder().encode([text])[0]
    seen = {}
    for i in range(1000):
        v = tuple(one(f"w{i}"))
        if tuple(-x for x in v) in seen:
            pair = f"w{i} {seen[tuple(-x for x in v)]}"
            break
        seen[v] = f"w{i}"
    assert sum(x * x for x in one(pair)) == 1.0 and one(pair) == one(f"w{i}") and not any(one(" \x1f"))


def test_parts_are_committed_together_and_the_log_is_read_once(spark, tmp_path, monkeypatch):
    from rankloom.sources.commits import Log

    reads, live = [], Log.live
    monkeypatch.setattr(Log, "live", lambda self: reads.append(1) or live(self))
    rows = spark.createDataFrame([(f"{i}", float(i)) for i in range(100)], "doc_id string, x double")
    assert W.append_in_parts(rows, str(tmp_path / "t"), lambda p: p, every=5) == 100
    assert len(reads) == 2 and len(list((tmp_path / "t" / "log").iterdir())) == 5 and W.grown(spark, str(tmp_path / "t")).count() == 100
