import hashlib
import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from rankloom.llm import pii as P

from .conftest import prose

PATTERNS = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = [True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), 16 <= len(d) <= 19 and luhn(d), 8 <= len(d) <= 15][k]
            if ok:
                out.append((k, m.start(), m.end()))
    return out


def digest(spans):
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for k, a, b in spans)


TRICKY = [
    "a@b.c@d.e.f", "é😀 x@y.z_x@q.w 1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 0001.2.3.255", "4" * 30 + " 4111 1111 1111 1111, 4111-1111-1111-1111-1 +1 (319) 555-5132 +49 30 1234",
    "a.@-.-@b.c", "+1+22 333-444.5 (6)) +1", "1.2.3.4@a.b 4111111111111111@a.b", "x" * 900 + "@" + "9" * 900, "9" * 2000, "1." * 2000, "a@" + "b." * 3000, "12." * 3 + "4 5 6 7 8 9 1 2 3 4 5 6 7", "+1 2", "٣.1.1.1.1",
]


def test_base_spans(spark, odd, none):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", *TRICKY])], "doc_id long, text string")
    for r in P.find_personal_data(docs).collect():
        assert [tuple(x) for x in r["base"]] == brute(docs.where(F.col("doc_id") == r["doc_id"]).first()["text"]), r["doc_id"]
    assert P.find_personal_data(odd).count() == odd.count() and P.find_personal_data(none).count() == 0


def test_long_runs_take_linear_time(spark):
    docs = spark.createDataFrame([(0, "9" * 200_000), (1, "x" * 200_000 + "@"), (2, "1-" * 100_000), (3, "+1" + "(" * 200_000)], "doc_id long, text string")
    assert {r["doc_id"]: len(r["base"]) for r in P.find_personal_data(docs).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}


def test_query_equals_brute_force(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in P.op7(spark, sf).collect():
        base = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == j for x in base) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(digest(base).encode()).hexdigest()
        assert set(digest(base).split(",")) <= set(r["spans"].split(",")) | {""}


def test_added_spans_and_redaction(spark):
    rows = [(i, f"mail me: user{i} [at] example [dot] com or user{i}@example.com, call +1 (319) 555-51{i % 90 + 10}") for i in range(60)]
    rows += [(100, "please call (319) 555-5132 today"), (101, "version 319 555 5132 of it"), (102, "clean prose at home.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = P.find_personal_data(docs)
    by = {r["doc_id"]: r for r in found.collect()}
    assert [tuple(x) for x in by[100]["spans"]] == [(3, 12, 26)] and by[100]["base"] == []
    assert by[102]["spans"] == [] and len(by[0]["base"]) == 2 and len(by[0]["spans"]) == 3
    assert P.redact(docs).where("doc_id = 0").first()["text"] == "mail me: <email> or <email>, call <phone>"
    assert P.redact(docs).where("doc_id = 102").first()["text"] == rows[-1][1]


def loose_brute(text):
    """The loose candidates (kind, start, end) that meet no base span."""
    own = regex_spans(text)
    return [(k, a, b) for k, a, b in own if not any(x < b and a < y for _, x, y in brute(text))]


def regex_spans(text):
    import regex

    return [(P.ALL_KINDS.index(k), m.start(), m.end()) for k, (_, p) in P.LOOSE.items() for m in regex.finditer(p, text or "")]


def test_candidates_equal_brute_force(spark, sf, odd):
    tricky = [*TRICKY, "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" and 7536784127813050 4845168114407329 é", "a at b dot com b [at] c.org 1:2:3:4:5:6:7:8 3782 822463 10005 (319) 555-5132 +1 (319) 555-5132 x1" + "y" * 30]
    docs = spark.createDataFrame(list(enumerate(tricky)), "doc_id long, text string").union(spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id + 1000", "text")).union(odd.selectExpr("doc_id + 5000", "text"))
    texts = Counter()
    for r in P.candidates(docs).collect():
        texts[r["doc_id"], tuple((x["kind"], x["start"], x["stop"], x["loose"]) for x in r["spans"])] += 1
    assert texts == Counter((r["doc_id"], tuple((*x, False) for x in brute(r["text"])) + tuple((*x, True) for x in loose_brute(r["text"]))) for r in docs.collect())


def test_added_spans_equal_the_model_by_hand(spark, sf):
    """The classifier's decisions, made again from the candidates with the same weights, one at a time."""
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet").select("doc_id", "text")
    rows = P.candidates(docs).collect()
    keys = ["kind", "loose", *P.VOTES, *P.TRAITS]
    n = Counter(tuple(x[k] for k in keys) for r in rows for x in r["spans"])
    patterns = [dict(zip(keys, k), n=v) for k, v in sorted(n.items())]
    post = P.estimate(patterns)
    weights = P.train(patterns, post)
    least = P.add_at(patterns, post, weights)
    voted = lambda p: p["context"] != -1 and (p["gazetteer"] == 1 or p["context"] == 1 or p["kind"] == 2 and p["arithmetic"] == 1)
    taken = [(p, q) for p, q in zip(patterns, post) if p["loose"] and voted(p) and P.probability(weights, p) >= least]
    assert taken and sum(p["n"] * q for p, q in taken) >= P.PRECISION * sum(p["n"] for p, _ in taken)
    expected = {}
    for r in rows:
        added = [x for x in r["spans"] if x["loose"] and voted(x) and P.probability(weights, x.asDict()) >= least]
        expected[r["doc_id"]] = sorted((x["kind"], x["start"], x["stop"]) for x in added if not any(y["kind"] < x["kind"] and y["start"] < x["stop"] and x["start"] < y["stop"] for y in added))
    for r in P.find_personal_data(docs).collect():
        spans = sorted(tuple(x) for x in r["spans"])
        assert [tuple(x) for x in r["secrets"]] == [x for x in spans if x[0] == 4]
        base = sorted(tuple(x) for x in r["base"])
        assert sorted(base + expected[r["doc_id"]]) == spans
    assert sum(map(len, expected.values())) > 10


def test_planted_data_is_found_and_clean_texts_are_not(spark):
    """Data that the base patterns miss, each beside what merely looks like it."""
    r = random.Random(8)
    number = lambda n: "".join(r.choice("123456789") for _ in range(n))

    def card():
        head = "4" + number(14)
        return next(head + c for c in "0123456789" if luhn(head + c))

    hexes = lambda: "".join(r.choice("0123456789abcdef") for _ in range(40))
    plant = [
        lambda: f'token = "{hexes()}"', lambda: f"{number(16)} {card()}", lambda: f"write to joe{number(2)} [at] mail{number(1)} [dot] com", lambda: f"call (3{number(2)}) 555-{number(4)}",
    ]
    decoy = [lambda: f"commit {hexes()}", lambda: f"invoice {number(16)}", lambda: "he sat at home, period", lambda: f"version 319 555 {number(4)}", lambda: "some-long-compound-word-without-meaning"]
    rows = [(i, f"{prose(i, 30)} {plant[i % 4]()} {prose(i + 1, 20)}") for i in range(200)] + [(1000 + i, f"{prose(i, 30)} {decoy[i % 5]()} {prose(i + 1, 20)}") for i in range(200)]
    rows += [(2000 + i, f"{prose(i, 30)} mail a{i}@b.com, +1 (319) 555-{number(4)}, {card()} {prose(i + 1, 20)}") for i in range(100)]
    found = {x["doc_id"]: x for x in P.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = {i: len(x["spans"]) > len(x["base"]) or bool(x["base"]) for i, x in found.items()}
    valid = {i for i, t in rows if 1000 <= i < 2000 and brute(t)}
    assert sum(hit[i] for i in range(200)) >= 180
    assert sum(hit[1000 + i] for i in range(200) if 1000 + i not in valid) <= 10
    assert all(len(found[2000 + i]["base"]) == 3 for i in range(100))


def test_many_matches_take_linear_time(spark):
    def seconds(n):
        text = " ".join(f"a{i}@b.com and (319) 555-{i % 9000 + 1000}" for i in range(n))
        began = time.time()
        row = P.find_personal_data(spark.createDataFrame([(0, text)], "doc_id long, text string")).first()
        assert len(row["base"]) == n
        return time.time() - began

    seconds(10)
    assert seconds(12_000) < 6 * seconds(3_000) + 3


def test_em_finds_the_reliable_labelers():
    """Two labelers agree with a hidden truth, the context labeler is noise."""
    patterns = []
    for truth in (1, -1):
        for noise in (1, -1):
            patterns.append({"kind": 3, "pattern": 0, "gazetteer": truth, "context": noise, "boundary": truth, "arithmetic": 0, "loose": True, "n": 500, **dict.fromkeys(P.TRAITS, 0)})
    post = P.estimate(patterns)
    assert post[0] > 0.9 and post[1] > 0.9 and post[2] < 0.1 and post[3] < 0.1
    weights = dict(zip(P.FEATURES, P.train(patterns, post)))
    assert weights["gazetteer"] > 0.5 and abs(weights["context"]) < 0.2
