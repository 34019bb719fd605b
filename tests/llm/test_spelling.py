import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import spelling as S


def by_hand(rows, least_length=6, least_count=5, times=5):
    seen = Counter()
    for d, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least_length:
                seen[run] += 1
    words = {w: n for w, n in seen.items() if n >= least_count}
    out = {}
    for w, n in words.items():
        near = [u for u in words if one_edit(w, u)]
        best = min(near, key=lambda u: (-words[u], u), default=None)
        form = best if best and words[best] >= times * n else None
        out[w] = (n, len(near), form, words[form] if form else None)
    root = {}
    for w in words:
        r = w
        while out[r][2]:
            r = out[r][2]
        root[w] = r
    return {w: (*v, root[w]) for w, v in out.items()}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def answer(df):
    return {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in df.collect()}


@settings(deadline=None, max_examples=200)
@given(st.sets(st.text("abé", max_size=6), min_size=1, max_size=60), st.text("abé", max_size=6))
def test_trie_finds_what_comparing_finds(words, word):
    listed = sorted(words)
    trie = S.Trie.unpack(S.Trie.of(listed, list(range(len(listed)))).pack())
    assert trie.near(word) == {w: k for k, w in enumerate(listed) if one_edit(word, w)}


def corpus(n=400, seed=3):
    r = random.Random(seed)
    base = ["colour", "analyse", "élégante", "naïveté", "organise", "Centre", "theatre", "grøt×er"]
    rows = []
    for d in range(n):
        words = []
        for _ in range(r.randrange(1, 40)):
            w = base[min(r.randrange(30), len(base) - 1)]
            if r.random() < 0.1:
                k = r.randrange(len(w))
                w = w[:k] + r.choice(["", "x", w[k] * 2]) + w[k + 1 :]
            words.append(w)
        rows.append((d, r.choice([" ", ", ", "\n"]).join(words)))
    return rows + [(1, "COLOUR Colour"), (1, "COLOUR Colour"), (None, "colour " * 7), (None, None), (7, "")]


def test_variants_equal_comparing_all_words(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = by_hand(rows)
    assert len(want) > 25 and len({v[4] for v in want.values()}) < len(want) and any(v[2] for v in want.values())
    assert answer(S.variants(docs)) == want
    # the same with many small shards in several rounds, and other thresholds
    assert answer(S.variants(docs, shard_words=7, at_once=2)) == want
    assert answer(S.variants(docs, times=2, least_length=4, least_count=2)) == by_hand(rows, 4, 2, 2)


def test_shards_are_full_and_bounded(spark, tmp_path):
    words = sorted({prose_word(i) for i in range(1000)})
    table = spark.createDataFrame([(w, 5 + i) for i, w in enumerate(words)], "word string, n long").repartition(9)
    for k, (size, chars, least) in enumerate(((300, 10**6, 300), (10**6, 10**6, len(words)), (10**6, 500, 1))):
        tries = [S.Trie.unpack(bytes(r["shard"])) for r in S.trie_shards(table, f"{tmp_path}/{k}", size, chars).orderBy("number").collect()]
        assert [n for t in tries for n in t.counts] == [5 + i for i in range(len(words))]  # in order, each word once
        assert all(len(t.counts) <= size for t in tries) and all(len(t.counts) >= least for t in tries[:-1]) and all(len(t.labels) <= chars + 1 for t in tries)


def prose_word(i):
    return "".join(chr(97 + (i * 7 + k * k * (i % 5)) % 26) for k in range(3 + i % 6))


def test_chains_are_followed(spark):
    rows = [(1, "abcdef " * 700 + "abcdeg " * 130 + "abcdhg " * 25 + "abcihg " * 5 + "jbcihg " * 5)]
    got = answer(S.variants(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == by_hand(rows) and got["abcihg"][4] == "abcdef"


def test_query_over_the_whole_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert answer(S.op11(spark, sf)) == by_hand(rows)


def test_odd_rows(spark, odd, none):
    assert answer(S.variants(odd)) == by_hand([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert S.variants(none).count() == 0 and S.variants(none).columns == ["word", "n", "n_near", "form", "form_n", "root"]
