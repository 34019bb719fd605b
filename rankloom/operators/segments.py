"""An index that grows: segments of packed postings, merged in levels; deletions are marks until a merge.

path/segments/<name>/: parts (operators.blocks), docs(tile, place, doc_id, doc_length), terms(term, df, cf). path/marks/<name>/: places(segment, tile, place,
doc_id, doc_length) of documents that are gone, and terms(segment, term, df, cf), what they had. The log (sources.commits) says what is live. When `fan`
segments are on a level, they become one of the next level, without what is marked: a document is rewritten once a level.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.operators import blocks
from rankloom.operators import index as I
from rankloom.sources.commits import Change, Log

#: Segments of a level that become one of the next; bits of a tile's number below those of its segment.
FAN, SHIFT = 8, 44


def _union(frames: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], schema)


class Segments:
    def __init__(self, spark: SparkSession, path: str, fan: int = FAN):
        if fan < 2:
            raise ValueError("a merge takes two segments or more")
        self.spark, self.path, self.fan, self.log = spark, path, fan, Log(spark, path)

    # --- what is there ---

    def _live(self) -> tuple[list[Change], list[Change], dict[str, int]]:
        """(segments, marks, sources)."""
        there, done, _ = self.log.live()
        return [c for c in there if c.level >= 0], [c for c in there if c.level < 0], done

    def _read(self, segment: Change, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/segments/{segment.name}/{table}").withColumn("segment", F.lit(segment.number).cast("long"))

    def _marked(self, marks: list[Change], table: str, schema: str) -> DataFrame:
        return _union([self.spark.read.parquet(f"{self.path}/marks/{m.name}/{table}") for m in marks], self.spark, schema)

    def _places(self, segments: list[Change], marks: list[Change]) -> DataFrame:
        """segment, tile, place, doc_id, doc_length of marked documents in these segments."""
        gone = self._marked(marks, "places", "segment long, tile long, place int, doc_id string, doc_length long")
        return gone.where(F.col("segment").isin([s.number for s in segments]))

    def docs(self) -> DataFrame:
        """segment, tile, place, doc_id, doc_length of all documents that are not marked."""
        segments, marks, _ = self._live()
        every = _union([self._read(s, "docs") for s in segments], self.spark, "tile long, place int, doc_id string, doc_length long, segment long")
        return every.join(self._places(segments, marks).select("segment", "tile", "place"), ["segment", "tile", "place"], "left_anti") if marks else every

    def _parts(self, segments: list[Change], marks: list[Change]) -> DataFrame:
        """parts of segments under numbers of their own; ids of marked documents are null."""
        every = _union([self._read(s, "parts") for s in segments], self.spark, f"{blocks.SCHEMA}, segment long")
        if marks:
            gone = self._places(segments, marks).groupBy(F.col("segment").alias("g_segment"), F.col("tile").alias("g_tile")).agg(F.collect_list("place").alias("gone"))
            own = every.where("term is null").join(gone, (F.col("segment") == F.col("g_segment")) & (F.col("tile") == F.col("g_tile")), "left").drop("g_segment", "g_tile")
            ids = F.when(F.col("gone").isNull(), F.col("ids")).otherwise(F.transform("ids", lambda x, i: F.when(~F.array_contains("gone", i), x)))
            every = own.withColumn("ids", ids).drop("gone").unionByName(every.where("term is not null"))
        return every.withColumn("tile", F.shiftleft(F.col("segment"), SHIFT) + F.col("tile")).select(*[c.split()[0] for c in blocks.SCHEMA.replace("array<struct<block: int, n: int, top: int>>", "x").split(", ")])

    def index(self) -> I.Index:
        """The index of all documents that are there, as if it were built at once."""
        segments, marks, _ = self._live()
        live, parts = [s.number for s in segments], self._parts(segments, marks)
        minus = self._marked(marks, "terms", "segment long, term string, df long, cf long").where(F.col("segment").isin(live)).select("term", -F.col("df"), -F.col("cf")).toDF("term", "df", "cf")
        sums = _union([self._read(s, "terms").select("term", "df", "cf") for s in segments] + [minus], self.spark, "term string, df long, cf long")
        terms = sums.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where("df > 0")
        gone = self._places(segments, marks).agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("tokens")).first()
        n, tokens = sum(s.docs for s in segments) - gone["n"], sum(s.tokens for s in segments) - gone["tokens"]
        stats = self.spark.createDataFrame([(n, tokens / n if n else 0.0)], "num_docs long, avg_doc_length double")
        terms = I.weighted_terms(terms, stats)
        postings = blocks.unpack(parts)
        return I.Index(postings, self.docs().select("doc_id", "doc_length"), I.norms(postings, terms), terms, stats, parts)

    # --- what changes it ---

    def append(self, rows: DataFrame, source: str = "", number: int | None = None, fresh: bool = False) -> bool:
        """Adds rows(doc_id, tokens) as a segment; older documents of the same ids are marked, unless all are known to be `fresh`.

        With `number`, the rows are batch `number` of `source`: one that the log has already is not added again, and False is returned.
        """
        if number is not None and self.log.live()[1].get(source, -1) >= number:
            return False
        segments, marks, _ = self._live()
        changes = [self._segment(blocks.pack(rows.select("doc_id", "tokens")), 0)]
        if not fresh and segments:
            changes += self._mark(self.spark.read.parquet(f"{self.path}/segments/{changes[0].name}/docs").select("doc_id"), segments, marks)
        self.log.commit(changes + ([] if number is None else [Change("done", source, number=number)]))
        self.merge()
        return True

    def delete(self, ids: DataFrame) -> None:
        """Marks the documents of ids(doc_id). Unknown ids are nothing."""
        segments, marks, _ = self._live()
        changes = self._mark(ids.select("doc_id"), segments, marks) if segments else []
        if changes:
            self.log.commit(changes)

    def merge(self) -> int:
        """Merges until no level has `fan` segments; the number of merges."""
        for turn in range(1000):
            segments, marks, _ = self._live()
            by_level: dict[int, list[Change]] = {}
            for s in segments:
                by_level.setdefault(s.level, []).append(s)
            full = next((level for level in sorted(by_level) if len(by_level[level]) >= self.fan), None)
            if full is None:
                return turn
            old = sorted(by_level[full], key=lambda s: s.number)[: self.fan]
            parts = self._parts(old, marks)
            own = parts.where("term is null").select(F.explode(F.arrays_zip("ids", "lengths")).alias("d")).select(F.col("d.ids").alias("doc_id"), F.col("d.lengths").alias("length")).where("doc_id is not null")
            counted = blocks.unpack(parts).groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col("tf").cast("int")).alias("tfs"))
            empty = F.array()
            counted = own.join(counted, "doc_id", "left").select("doc_id", "length", F.coalesce("terms", empty.cast("array<string>")).alias("terms"), F.coalesce("tfs", empty.cast("array<int>")).alias("tfs"))
            new = self._segment(blocks.pack_counted(counted), full + 1)
            left = {s.number for s in segments} - {s.number for s in old}
            # marks of merged segments alone are gone with them
            spent = [m for m in marks if not self._marked([m], "places", "").where(F.col("segment").isin(sorted(left))).take(1)]
            self.log.commit([new, *(Change("drop", s.name) for s in old + spent)])
        raise RuntimeError("merges do not end")

    def _segment(self, parts: DataFrame, level: int) -> Change:
        """Writes a segment, which counts once it is committed."""
        there, _, _ = self.log.live()
        name = uuid.uuid4().hex
        # numbers rise with every segment that was ever committed; those of two merges at once cannot meet, as there is one writer
        number = max((c.number for c in there), default=-1) + 1
        path = f"{self.path}/segments/{name}"
        parts.write.parquet(f"{path}/parts")
        parts = self.spark.read.schema(blocks.SCHEMA).parquet(f"{path}/parts")
        own = parts.where("term is null").select("tile", F.posexplode(F.arrays_zip("ids", "lengths")).alias("place", "d"))
        own.select("tile", "place", F.col("d.ids").alias("doc_id"), F.col("d.lengths").cast("long").alias("doc_length")).write.parquet(f"{path}/docs")
        add = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
        parts.where("term is not null").groupBy("term").agg(F.sum(F.size("gaps")).alias("df"), F.sum(add("tfs")).alias("cf")).write.parquet(f"{path}/terms")
        n = self.spark.read.schema("doc_length long").parquet(f"{path}/docs").agg(F.count("*").alias("n"), F.coalesce(F.sum("doc_length"), F.lit(0)).alias("tokens")).first()
        return Change("add", name, level, number, n["n"], n["tokens"])

    def _mark(self, ids: DataFrame, segments: list[Change], marks: list[Change]) -> list[Change]:
        """Writes the places of documents with these ids, and what terms they have; nothing if there are none."""
        name = uuid.uuid4().hex
        path = f"{self.path}/marks/{name}"
        hits = self.docs().join(ids.distinct(), "doc_id", "left_semi").select("segment", "tile", "place", "doc_id", "doc_length")
        hits.write.parquet(f"{path}/places")
        hits = self.spark.read.parquet(f"{path}/places")
        if not hits.take(1):
            return []
        # postings of the tiles that are touched, then of the documents
        tiles = hits.select("segment", "tile").distinct()
        touched = _union([self._read(s, "parts") for s in segments], self.spark, f"{blocks.SCHEMA}, segment long").join(tiles, ["segment", "tile"], "left_semi")
        numbered = touched.withColumn("tile", F.shiftleft(F.col("segment"), SHIFT) + F.col("tile"))
        had = blocks.unpack(numbered, "tile").select(F.shiftright("tile", SHIFT).alias("segment"), "doc_id", "term", "tf").join(hits.select("segment", "doc_id").distinct(), ["segment", "doc_id"], "left_semi")
        had.groupBy("segment", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).write.parquet(f"{path}/terms")
        n: Column = F.count("*")
        r = hits.agg(n.alias("n"), F.sum("doc_length").alias("tokens")).first()
        return [Change("add", name, -1, max((s.number for s in segments), default=0), r["n"], r["tokens"])]
