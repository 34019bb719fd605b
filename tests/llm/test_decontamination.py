import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import decontamination as D

from .conftest import prose

ITEM = "A train leaves Paris at 10 km from Berlin and Anna walks 25 minutes to see her friend Peter before 7 hours of work begin in the old town house."
RENAMED = ITEM.replace("Paris", "Rome").replace("Berlin", "Vienna").replace("Anna", "Carla").replace("Peter", "Marco").replace("10", "12").replace("25", "45")
MIXED_UP = ITEM.replace("Paris", "Rome").replace("Berlin", "Rome").replace("Anna", "Rome").replace("Peter", "Rome").replace("10", "12").replace("25", "12").replace("7", "12")


def held(text, *items):
    return [m[0] for m in D.Index(list(enumerate(items))).matches(text)]


def test_matches():
    assert held(f"{prose(1, 30)}. {ITEM} {prose(2, 30)}", ITEM) == [0]
    assert held(f"{prose(1, 30)}.\n{RENAMED}\n{prose(2, 30)}", ITEM) == [0]
    assert held(ITEM.upper(), ITEM) == [0] and held(ITEM.lower().replace(",", " "), ITEM) == [0]
    # slots that are not renamed one to one, and patterns of placeholders alone
    assert held(MIXED_UP, ITEM) == []
    assert held("Then 12 km and 14 km and 9 kg and 3 m.", "Then 1 cm and 2 kg and 7 m and 8 km.") == []
    # a half of the item is a run of over 13 tokens; a quarter is not
    words = ITEM.split()
    assert held(" ".join(words[:16]) + " " + prose(3, 40), ITEM) == [0] and held(" ".join(words[:7]) + " " + prose(3, 40), ITEM) == []
    # short items are held by themselves alone
    assert held("Yes, indeed!", "yes indeed") == [0] and held("oh yes indeed it is so", "yes indeed") == [] and held("", "") == [] and held(None, ITEM) == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from("aA1 km.\n5Bob,'é%"), max_size=60), min_size=1, max_size=6))
def test_scanner_finds_every_candidate(texts):
    items = [(0, "a km 5 Bob. A1 km 5 k."), (1, "Bob a a a a 5 %"), (2, "b"), (3, texts[0])]
    ix = D.Index(items)
    known = set(ix.sorted.tolist())
    slow = {i for i, t in enumerate(texts) for n in D.TEMPLATES if any(h in known for h in D.window_hashes(D.template(t, n)[0]).tolist())}
    assert slow <= set(D.Scanner(ix).candidates(texts))


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=40) | st.text(st.sampled_from("aA1 km.\n5Bob,'é%-’:/°!ΣςΟß²½ǅÀ٣"), max_size=60) | st.lists(st.sampled_from("Anna has 5 km. Bob's 3.5 kg\nA1 Mary-Ann % 7:30 the USA".split(" ")), max_size=12).map(" ".join))
def test_arrays_have_the_templates(text):
    """The scanner's arrays are the templates' hashes, token by token."""
    text = text.replace("\u0130", "")
    scan = D.Scanner(D.Index([]))
    _, h, kind, begins = scan._tokens(text)
    word = kind != 4
    arrays = scan._templates(h[word], kind[word], begins[word], np.zeros(int(word.sum()), int))
    for names, a in zip(D.TEMPLATES, arrays):
        assert a.tolist() == D.token_hashes(D.template(text, names)[0]).tolist(), names


def test_long_texts_are_cut_without_loss(monkeypatch):
    monkeypatch.setattr(D.Scanner, "STEP", 700)
    scan = D.Scanner(D.Index([(0, ITEM)]))
    texts = [" ".join([prose(k, 17 * k), ITEM, prose(k + 1, 90)]) for k in range(1, 40)]
    assert scan.candidates(texts) == list(range(39)) and scan.candidates([prose(k, 400) for k in range(20)]) == []
    assert all(max(map(len, scan._pieces(t))) <= 700 for t in texts) and scan.candidates(["x" * 5000, "\u0130"]) == [0, 1]


def test_query_equals_containment(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    expected = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in d["text"]}
    assert {(r["doc_id"], r["item_id"]) for r in D.op10(spark, sf).collect()} == expected and expected


def test_blocks_and_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, prose(3, 30), "x"), (2, prose(4, 60), "x"), (2, prose(4, 60), "x"), (3, None, "x"), (4, "", "x"), (None, prose(1, 20_000), None)], "item_id long, text string, kept string")
    rows = sorted((str(r["doc_id"]), str(r["item_id"])) for r in D.find_contaminated(odd, bench).collect())
    assert rows == [("1", "1"), ("4", "None"), ("None", "2")]
    assert sorted((str(r["doc_id"]), str(r["item_id"])) for r in D.find_contaminated(odd, bench, 40).collect()) == rows
    clean = D.drop_contaminated(odd, bench, 40)
    assert clean.columns == odd.columns and clean.count() == odd.count() - 3
    assert D.find_contaminated(none, bench).count() == 0 and D.find_contaminated(odd, bench.limit(0)).count() == 0 and D.drop_contaminated(odd, bench.limit(0)).count() == odd.count()


APPLES = "Anna has 5 apples. Peter gives her 3 more apples. Mary eats 2 of them. How many apples has Anna now?"


def test_names_that_begin_sentences(spark):
    copy = APPLES.replace("Anna", "Carla").replace("Peter", "Marco").replace("Mary", "Lisa").replace("5", "8").replace("3", "4")
    text = f"{prose(1, 30)}.\n{copy}\n{prose(2, 30)}"
    assert held(text, APPLES) == [0] and D.Scanner(D.Index([(0, APPLES)])).candidates([text]) == [0]
    docs, bench = spark.createDataFrame([(1, text), (2, prose(5, 90))], "doc_id long, text string"), spark.createDataFrame([(0, APPLES)], "item_id long, text string")
    assert [r["doc_id"] for r in D.find_contaminated(docs, bench).collect()] == [1]
    assert [r["doc_id"] for r in D.drop_contaminated(docs, bench).collect()] == [2]
    # not renamed one to one
    assert held(copy.replace("Marco", "Carla").replace("Lisa", "Carla"), APPLES) == []


def test_short_items_with_a_changed_word():
    item = "Please send the seven video clips to Anna Smith in April because the club meets again then"
    words, around = item.split(), f"{prose(1, 30)}.\n{{}}\n{prose(2, 30)}"
    copies = [words[:8] + ["old"] + words[8:], words[:7] + words[8:], words[:6] + ["for"] + words[7:]]
    for copy in [*map(" ".join, copies), item.replace("Anna Smith", "Carla")]:
        assert held(around.format(copy), item) == [0], copy
    # less than 0.8 of the tokens, another order, and pieces far apart
    assert held(around.format(" ".join(words[:8])), item) == []
    assert held(around.format(" ".join(words[8:] + words[:8])), item) == []
    assert held(around.format(" ".join(words[:8]) + " " + prose(3, 20) + " " + " ".join(words[8:])), item) == []


def test_text_ids_and_blocks_of_one_item(spark):
    docs = spark.createDataFrame([("a", ITEM), ("b", "Well: " + RENAMED), ("c", prose(5, 200)), (None, ITEM), ("d", None), ("e", "")], "doc_id string, text string")
    items = spark.createDataFrame([("x", ITEM), ("y", prose(6, 30)), (None, None), (None, prose(7, 40)), ("x", ITEM)], "item_id string, text string")
    for limit in (D.BLOCK_WINDOWS, 1):
        found = D.find_contaminated(docs, items, limit).collect()
        assert sorted((str(r["doc_id"]), r["item_id"]) for r in found) == [("None", "x"), ("a", "x"), ("b", "x")]
        assert sorted(r["doc_id"] for r in D.drop_contaminated(docs, items, limit).collect()) == ["c", "d", "e"]
    assert D.find_contaminated(docs, items.limit(0)).count() == 0 and D.find_contaminated(docs.limit(0), items).count() == 0


def test_memory_of_a_block():
    import pickle

    items = [(k, prose(k, 200)) for k in range(200)]
    windows = sum(len(D.template(t)[0]) for _, t in items)
    assert len(pickle.dumps(D.Index(items))) < (1 << D.Index.BITS) + 60 * windows
