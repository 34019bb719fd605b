import zlib
from collections import Counter

import corpus_pipeline as P
from rankloom.llm import mixing, quality
from rankloom.llm.common import written

from .test_near_dedup import brute as near


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "decontaminate", "mix_sources", "shard"]
    step = lambda name, d: written(stages[name](spark, d, sf), str(tmp_path / name))

    kept = {r["doc_id"] for r in quality.op8(spark, sf).where("kept").collect()}
    good = step("quality_rules", docs)
    rows = good.collect()
    assert good.columns == columns and {r["doc_id"] for r in rows} == kept and len(rows) == len(kept)

    component = near([(r["doc_id"], r["text"]) for r in rows])
    unique = step("near_dedup", good)
    rows = unique.collect()
    assert unique.columns == columns and sorted(r["doc_id"] for r in rows) == sorted(set(component))

    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    clean = step("decontaminate", unique)
    assert clean.columns == columns and {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in rows if not any(i in r["text"] for i in items)}

    mixed = step("mix_sources", clean)
    times = {r["doc_id"]: int(r["taken"] / r["size"] + 0.5) for r in mixing.mix_documents(clean).collect() if r["size"]}
    assert mixed.columns == columns and Counter(r["doc_id"] for r in mixed.collect()) == Counter({d: n for d, n in times.items() if n})

    placed = step("shard", mixed).collect()
    assert Counter((r["doc_id"], r["text_crc32"]) for r in placed) == Counter((r["doc_id"], zlib.crc32(r["text"].encode())) for r in mixed.collect())
    assert sorted(map(str, P.run(spark, sf).collect())) == sorted(map(str, placed))


def test_odd_rows_and_empty_tables(spark, odd, none, tmp_path):
    names = odd.withColumnsRenamed({"size": "target", "kept": "taken", "slot": "shard"}).withColumn("key", odd["doc_id"]).withColumn("order", odd["text"])
    for k, (docs, expected) in enumerate(((odd, {1, 4, None}), (names, {1, 4, None}), (none, set()))):
        docs.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{k}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/{k}/benchmark.parquet")
        rows = docs
        for name, stage in P.STAGES[:-1]:
            rows = written(stage(spark, rows, f"{tmp_path}/{k}"), f"{tmp_path}/{k}/{name}")
            assert rows.columns == docs.columns, name
        assert {r["doc_id"] for r in rows.collect()} <= expected
        placed = P.run(spark, f"{tmp_path}/{k}").collect()
        assert Counter(r["text_crc32"] for r in placed) == Counter(zlib.crc32(r["text"].encode()) for r in rows.collect())
        for s in {r["shard"] for r in placed}:
            assert sorted(r["slot"] for r in placed if r["shard"] == s) == list(range(sum(r["shard"] == s for r in placed)))
