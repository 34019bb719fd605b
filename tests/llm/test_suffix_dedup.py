import hashlib
import random

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import suffix_dedup as S

from .conftest import prose


def by_hand(rows, length):
    """(doc_id, text) to (n_bytes, n_removed, n_spans, sha256), with a dictionary of all strings. Rows are distinct and in order."""
    seen, out = set(), []
    for _, text in rows:
        raw = (text or "").encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        runs = int((gone[1:] < gone[:-1]).sum())
        out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def answer(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r["doc_id"])]


def corpus(seed, n=60, size=400, letters="abcde é"):
    """Texts with passages of earlier ones, edited here and there, and runs of one letter."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(r.randrange(1, 5)):
            if texts and r.random() < 0.6:
                t = r.choice(texts)
                a = r.randrange(len(t) + 1)
                t = list(t[a : a + r.randrange(size)])
                for _ in range(r.randrange(3)):
                    if t:
                        t[r.randrange(len(t))] = r.choice(letters)
                parts.append("".join(t))
            else:
                parts.append("".join(r.choice(letters) for _ in range(r.randrange(size // 3))))
            if r.random() < 0.1:
                parts.append("z" * r.randrange(size))
        texts.append("".join(parts))
    return list(enumerate(texts))


@settings(deadline=None, max_examples=100)
@given(st.binary(min_size=0, max_size=300).map(lambda x: bytes(c % 3 for c in x)), st.integers(30, 400))
def test_phrases_cover_all_windows_and_know_their_bytes(raw, step):
    length, q = 20, 8
    ids, whole, at = S.phrases(raw, length, q, max(step, 2 * length))
    windows = [w for x in at.tolist() for w in range(x >> 16, (x >> 16) + (x & 255) + 1)]
    assert windows == list(range(max(0, len(raw) - length + 1)))
    grams, known = S.gram_ids(raw, q), {}
    for g, k, x in zip(ids.tolist(), whole.tolist(), at.tolist()):
        first, anchor = x >> 16, (x >> 16) + (x >> 8 & 255)
        last = first + (x & 255)
        assert g == int(grams[anchor]) and last <= anchor <= first + length - q
        body = (raw[first : last + length], anchor - first)
        assert known.setdefault(k, body) == body
    assert len(set(known.values())) == len(known)
    again = S.phrases(raw, length, q)
    assert all((a == b).all() for a, b in zip(again, (ids, whole, at)))


def test_equal_to_all_strings(spark):
    for seed, length, q, letters in ((1, 20, 8, "ab"), (2, 20, 8, "abcde é"), (3, 100, 32, "abcde é"), (4, 33, 8, "abcdefgh")):
        rows = corpus(seed, letters=letters)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        want = by_hand(rows, length)
        assert sum(w[1] for w in want) > 1000
        # few and many partitions, chunks of a few phrases, texts in small steps: every cut of a bucket
        for partitions, chunk, step, spread in ((1, 1 << 20, 1 << 18, 1000), (13, 300, 250, 2), (40, 2000, 220, 9)):
            assert answer(S.summarise(docs, length, q, partitions, chunk, step, spread)) == want, (seed, partitions)


def test_one_bucket_over_all_partitions(spark):
    shared = prose(5, 40)
    rows = [(d, prose(100 + d, 5) + " " + shared[: 150 + d % 60] + " " + prose(900 + d, 4)) for d in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for spread in (7, 1000):
        assert answer(S.summarise(docs, partitions=29, chunk=4000, spread=spread)) == by_hand(rows, 100)


def test_texts_and_runs(spark):
    run = prose(7, 30)
    rows = [(1, prose(8, 30) + run), (2, "é" + run + "ü"), (3, run)]
    got = {r["doc_id"]: r for r in S.dedup_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"] == rows[0][1] and got[1]["removed"] == [] and got[2]["text"] == "éü" and got[3]["text"] == ""
    assert [tuple(x) for x in got[2]["removed"]] == [(2, 2 + len(run))]


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    got = S.op13(spark, sf)
    assert got.columns == [x[0] for x in c.sql(S.SQL).description]
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(S.SQL).fetchall())


def test_odd_rows(spark, odd, none):
    rows = S.summarise(odd).collect()
    assert len(rows) == odd.count()
    key = lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)
    by_id = {}
    for r in sorted(rows, key=key):
        by_id.setdefault(r["doc_id"], []).append(tuple(r)[1:])
    size = len(prose(2, 80))
    # the repeated row is one document, its text goes from id 8; one of the null ids has no text
    assert [x[:3] for x in by_id[8]] == [(size, size, 1)] and all(x[1] == 0 for d in (1, 2, 3, 4, 5, 6, 7) for x in by_id[d]) and len(by_id[1]) == 3
    assert by_id[3] == [(0, 0, 0, hashlib.sha256(b"").hexdigest())] and by_id[2] == by_id[3]
    assert S.summarise(none).count() == 0 and S.dedup_bytes(none).count() == 0
    # two texts of one id are told apart, and one of them is first
    same = spark.createDataFrame([("x", prose(1, 40)), ("x", prose(1, 41)), (None, prose(1, 42)), ("x", prose(1, 40))], "doc_id string, text string")
    got = [r for r in S.summarise(same).collect()]
    assert len(got) == 4 and {r["n_removed"] for r in got if r["doc_id"] is None} == {0} and all(r["n_removed"] >= len(prose(1, 40)) for r in got if r["doc_id"])
