import itertools
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline as P
from rankloom.llm import near_dedup as N

from .conftest import prose


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """The least id of each row's component, from all pairs."""
    root, sets = list(range(len(rows))), [shingles(t) for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        both, all_ = len(sets[i] & sets[j]), len(sets[i] | sets[j])
        if 5 * both >= 4 * all_:
            root = [root[i] if r == root[j] else r for r in root]
    return [min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in root]


def test_stage_against_all_pairs(spark, sf):
    stage = dict(P.STAGES)["near_dedup"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(r["doc_id"] for r in stage(spark, docs, sf).collect()) == sorted(set(brute(rows)))


def test_near_and_merely_similar(spark, sf):
    words = prose(11, 200).split()

    def changed(*places):
        return " ".join("new" + str(k) if k in places else w for k, w in enumerate(words))

    # 4 changed words cost 20 of 196 shingles each way (0.81), 5 cost 25 (0.77); chains link what is not similar itself
    rows = [(1, changed()), (2, changed(10, 50, 90, 130)), (3, prose(12, 200)), (4, prose(12, 200) + " " + prose(13, 60)), (5, "One  two"), (6, "one two"), (7, None), (8, " \n"), (9, changed(10, 50, 90, 130, 170, 180, 190))]
    rows += [(20 + k, changed(k)) for k in range(5, 60, 5)] + [(1, changed())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in N.near_duplicates(docs).collect()}
    assert found == set(zip((i for i, _ in rows), brute(rows)))
    assert {(2, 1), (3, 3), (4, 4), (6, 5), (8, 7)} <= found
    assert sorted(r["doc_id"] for r in dict(P.STAGES)["near_dedup"](spark, docs, sf).collect()) == sorted(set(brute(rows)))


def test_edited_copies_against_all_pairs(spark):
    """A group whose members were edited apart, some alike: buckets stay open after the first round, and the prefix search decides."""
    r, words = random.Random(5), prose(21, 120).split()
    rows = []
    for k in range(160):
        own = list(words)
        for _ in range(r.randrange(9)):
            own[r.randrange(len(own))] = f"e{r.randrange(3)}" if k % 2 else f"own{k}x{r.randrange(50)}"
        rows.append((k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(x["doc_id"], x["component_id"]) for x in N.near_duplicates(docs).collect()}
    assert found == set(zip((i for i, _ in rows), brute(rows))) and 5 < len({c for _, c in found}) < 155


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.floats(0, 0.3))
def test_sketch_rules_out_no_similar_pair(seed, n, share):
    r = random.Random(seed)
    a = {r.getrandbits(64) for _ in range(n)}
    b = {x for x in a if r.random() > share} | {r.getrandbits(64) for _ in range(int(n * share / 2))}
    x, y = (N.parities(np.array(sorted(s), np.uint64)) for s in (a, b))
    apart = sum(((p ^ q) & (1 << 64) - 1).bit_count() for p, q in zip(x, y))
    assert len(x) == N.CELLS // 64 and apart <= len(a ^ b)


def test_odd_rows(spark, odd, none):
    kept = N.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 4").count() == 1 and kept.where("doc_id = 8").count() == 0
    assert N.drop_near_duplicates(none).count() == 0


def template_pages(n, own):
    """Pages of one template of 100 words, each with some words of its own."""
    r, words, out = random.Random(8), prose(31, 100).split(), []
    for k in range(n):
        page = list(words)
        for i, at in enumerate(r.sample(range(100), own)):
            page[at] = f"own{k}x{i}"
        out.append((k, " ".join(page)))
    return out


def test_pages_of_one_template_meet_few_others(spark, tmp_path):
    """Alike, but by less than 0.8: the rows that are put together stay in proportion to the pages."""
    from pyspark.sql import functions as F

    for n in (500, 2000):
        docs = spark.createDataFrame(template_pages(n, 3), "doc_id long, text string")
        nodes = docs.select(F.xxhash64("text").alias("node")).withColumn("root", F.col("node"))
        met = N.prefixes(nodes, docs, f"{tmp_path}/{n}")
        assert N.meetings(met).count() < 100 * n
    rows = template_pages(150, 3) + [(1000 + k, t) for k, t in template_pages(30, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(x["doc_id"], x["component_id"]) for x in N.near_duplicates(docs).collect()} == set(zip((i for i, _ in rows), brute(rows)))


def test_similar_sets_meet(spark, tmp_path):
    """Of random sets of many sizes, all pairs of similarity 0.8 or more are kept."""
    from pyspark.sql import functions as F

    r, rows = random.Random(9), []
    for k in range(120):
        words = prose(k // 8 + 40, r.choice([12, 30, 60, 61, 150]) + r.randrange(3)).split()
        for _ in range(r.randrange(3)):
            words[r.randrange(len(words))] = f"x{r.randrange(2)}"
        rows.append((k, " ".join(words + ["y"] * r.randrange(len(words) // 4 + 1))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keyed = docs.select(F.xxhash64("text").alias("node"), "text").distinct()
    sets = {x["node"]: shingles(x["text"]) for x in keyed.collect()}
    met = N.prefixes(keyed.select("node", F.col("node").alias("root")), docs, str(tmp_path))
    found = {tuple(sorted((x["node"], x["node_b"]))) for x in N.meetings(met).where(N.may_meet() & N.may_be_similar("sketch", "sketch_b", "size", "size_b")).collect()}
    alike = {tuple(sorted((a, b))) for a, b in itertools.combinations(sets, 2) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert alike <= found and len(alike) > 10
