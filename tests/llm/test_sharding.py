import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rankloom.llm import sharding as S


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = S.op9(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "bytes", None)
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    assert set(loads) == set(range(8)) and max(loads.values()) < 1.02 * min(loads.values())
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_maps_keep_most_slots(spark, tmp_path):
    first = S.first_map(spark, 4, 64)
    sizes = spark.range(64).select(F.col("id").cast("int").alias("vslot"), F.when(F.col("id") % 4 == 0, 300).otherwise(100).cast("long").alias("bytes"))
    S.save_map(first, str(tmp_path / "map"))
    second = S.rebalanced(S.load_map(spark, str(tmp_path / "map")), sizes, 4)
    S.save_map(second, str(tmp_path / "map"))
    assert S.load_map(spark, str(tmp_path / "map"), 0).count() == S.load_map(spark, str(tmp_path / "map")).count() == 64
    loads = [r[0] for r in S.load_map(spark, str(tmp_path / "map")).join(sizes, "vslot").groupBy("shard").agg(F.sum("bytes")).select("sum(bytes)").collect()]
    assert max(loads) - min(loads) <= 300
    moved = second.join(first, "vslot").where(second["shard"] != first["shard"])
    assert 0 < moved.count() <= 8 and moved.where(first["shard"] != 0).count() == 0
    # one shard more: what stays fits, what moves goes where there is room
    third = S.rebalanced(S.load_map(spark, str(tmp_path / "map")), sizes, 5)
    assert third.where("shard = 4").count() > 0 and third.select("version").distinct().first()[0] == 2


def test_stored_map_is_edited_not_begun_again(spark, sf, tmp_path):
    docs, path = spark.read.parquet(f"{sf}/documents.parquet"), str(tmp_path / "map")
    place = lambda rows: {r["doc_id"]: r["shard"] for r in rows}
    first = S.shard_documents(docs, map_path=path).collect()
    known = S.stored_versions(spark, path)
    again = S.shard_documents(docs, map_path=path).collect()
    assert len(first) == len(again) == docs.count() and place(first) == place(again) and S.stored_versions(spark, path) == known
    # a ninth shard: the next version, in which rows move to it alone or where they level the rest
    wider = S.shard_documents(docs, 9, map_path=path).collect()
    assert len(wider) == len(first) and {r["shard"] for r in wider} == set(range(9)) and S.stored_versions(spark, path) == [*known, known[-1] + 1]
    assert sum(place(first)[r["doc_id"]] != r["shard"] for r in wider) < len(first) / 2
    # a version that a lost driver left half-written does not count, and is written anew
    (tmp_path / "map" / f"version={known[-1] + 2}").mkdir()
    (tmp_path / "map" / f"version={known[-1] + 2}" / "part-0.parquet").write_text("half")
    fewer = S.shard_documents(docs, 5, map_path=path).collect()
    assert len(fewer) == len(first) and {r["shard"] for r in fewer} == set(range(5)) and {r["map_version"] for r in fewer} == {known[-1] + 2}
    with pytest.raises(ValueError, match="taken"):
        S.save_map(S.first_map(spark, 3, S.SLOTS), path)
    with pytest.raises(ValueError, match="once"):
        S.save_map(S.first_map(spark, 8).union(S.first_map(spark, 8)), path)


def test_odd_rows(odd, none):
    rows = S.shard_documents(odd).collect()
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == Counter((len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert S.shard_documents(none).count() == 0
