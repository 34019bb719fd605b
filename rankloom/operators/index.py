"""Inverted index as tables: postings(term, doc_id, tf, doc_length), doc_stats(doc_id, doc_length), doc_norms(doc_id, norm),
term_stats(term, df, cf, idf, tidf), one row of collection_stats, and parts, the postings packed in tiles of documents (operators.blocks), from which
BM25 ranks. Postings carry their document's length, so that scoring joins no table of documents; TF-IDF norms are made once, with the index."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.operators import blocks
from rankloom.sources.folders import stored, work_folder

TABLES = ("postings", "doc_stats", "doc_norms", "term_stats", "collection_stats", "parts")
#: Documents in a block of a packed posting list, about.
BLOCK = 4096


def bm25_idf(n: Column, df: Column) -> Column:
    return F.log1p((n - df + 0.5) / (df + 0.5))


def ranged(rows: DataFrame, *order: str) -> tuple[DataFrame, DataFrame]:
    """(rows with __p, the number of their range partition, and __i, their place in it from 0; __p and __base, the rows ahead of each partition).

    Ranges come from a sample, so that rows are written with their range: if both tables made them anew, they might differ.
    """
    path = work_folder(rows.sparkSession)
    rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()).write.parquet(path)
    parted = rows.sparkSession.read.parquet(path)
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy("__p").agg(F.count("*").alias("__n")).select("__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    return parted.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)) - 1), base


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with `number`: places in an order, from 0. Two levels: rows by range partition, then inside each, so that no task sorts all."""
    parted, base = ranged(rows, *order)
    return parted.join(F.broadcast(base), "__p").withColumn("number", (F.col("__base") + F.col("__i")).cast("long")).select(*rows.columns, "number")


def numbered_within(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """rows with `number`: places in an order inside each group, from 0. Two levels like numbered(), so that no task sorts a whole group."""
    parted = ranged(rows, by, *order)[0].drop("__i")
    ahead = Window.partitionBy(by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    base = parted.groupBy(by, "__p").agg(F.count("*").alias("__n")).select(by, "__p", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__base"))
    placed = parted.withColumn("__i", F.row_number().over(Window.partitionBy("__p", by).orderBy(*order)) - 1).join(base, [by, "__p"])
    return placed.select(*rows.columns, (F.col("__base") + F.col("__i")).cast("long").alias("number"))


@dataclass
class Index:
    postings: DataFrame
    doc_stats: DataFrame
    doc_norms: DataFrame
    term_stats: DataFrame
    collection_stats: DataFrame
    parts: DataFrame
    #: doc_id, length, terms, tfs (blocks.counted), if they are kept.
    docs: DataFrame | None = field(default=None, init=False)

    def vocabulary(self) -> DataFrame:
        return self.term_stats.select("term")

    def term_postings(self, term: str) -> DataFrame:
        """A term's postings, by id; no rows for an unknown term."""
        return self.postings.where(F.col("term") == term).select("doc_id", "tf").orderBy("doc_id")

    def doc_numbers(self) -> DataFrame:
        """doc_id, number: places in the order of ids, from 0."""
        return numbered(self.doc_stats.select("doc_id"), "doc_id")

    def doc_number(self, doc_id: str) -> int:
        """A document's number; KeyError for an unknown one."""
        found = self.doc_numbers().where(F.col("doc_id") == doc_id).first()
        if found is None:
            raise KeyError(doc_id)
        return found["number"]

    def doc_id(self, number: int) -> str:
        """The id at a number; IndexError beyond the last one."""
        found = self.doc_numbers().where(F.col("number") == number).first()
        if found is None:
            raise IndexError(number)
        return found["doc_id"]

    def save(self, path: str, buckets: int | None = None) -> None:
        """Postings are dealt out by ranges of term and document, and sorted, so that a reader prunes row groups by query terms and a term of very
        many documents is cut over several tasks and files. Parts are dealt by tile, and sorted by term."""
        n = buckets or int(self.postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.postings.repartitionByRange(n, "term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
        self.parts.repartition(n, "tile").sortWithinPartitions("term", "tile").write.mode("overwrite").parquet(f"{path}/parts")
        for name in TABLES[1:-1]:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")


def empty(spark: SparkSession) -> Index:
    """An index of no documents."""
    return build(spark.createDataFrame([], "doc_id string, tokens array<string>"))


def load(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{name}") for name in TABLES])


def load_or_build(spark: SparkSession, path: str, tokens: DataFrame, force: bool = False) -> Index:
    from pyspark.errors import AnalysisException

    if not force:
        try:
            return load(spark, path)
        except AnalysisException:
            pass
    build(tokens).save(path)
    return load(spark, path)


def term_frequencies(rows: DataFrame) -> DataFrame:
    """postings from rows(doc_id, tokens). Tokens of one document are counted where they are, then once more after the shuffle."""
    flat = rows.select("doc_id", F.size("tokens").cast("long").alias("doc_length"), F.explode("tokens").alias("term"))
    return flat.groupBy("term", "doc_id", "doc_length").agg(F.count("*").alias("tf")).select("term", "doc_id", "tf", "doc_length")


def build(rows: DataFrame, postings: DataFrame | None = None, parts: DataFrame | None = None) -> Index:
    """rows(doc_id, tokens). Documents without tokens count as documents of length 0. `postings`, `parts`: written or cached tables to use."""
    parts = blocks.pack(rows.select("doc_id", "tokens")) if parts is None else parts
    postings = term_frequencies(rows) if postings is None else postings
    docs = rows.select("doc_id", F.size("tokens").cast("long").alias("doc_length"))
    stats = docs.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"))
    terms = weighted_terms(postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), stats)
    return Index(postings, docs, norms(postings, terms), terms, stats, parts)


class Counted(Index):
    """The index of docs (blocks.counted, written) and their parts. Postings are the lists of docs, row by row; norms are made when they are asked for."""

    def __init__(self, docs: DataFrame, parts: DataFrame):
        pair = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
        self.docs, self.parts = docs, parts
        self.postings = docs.select("doc_id", F.col("length").alias("doc_length"), pair).select(F.col("p.terms").alias("term"), "doc_id", F.col("p.tfs").cast("long").alias("tf"), "doc_length")
        self.doc_stats = docs.select("doc_id", F.col("length").alias("doc_length"))
        self.collection_stats = self.doc_stats.agg(F.count("*").alias("num_docs"), F.coalesce(F.avg("doc_length"), F.lit(0.0)).alias("avg_doc_length"))
        self.term_stats = weighted_terms(self.postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")), self.collection_stats)

    @cached_property
    def doc_norms(self) -> DataFrame:
        return stored(norms_of_rows(self.docs, self.term_stats))


def weighted_terms(terms: DataFrame, stats: DataFrame) -> DataFrame:
    """term_stats of terms(term, df, cf) and the one row of collection_stats."""
    terms = terms.crossJoin(F.broadcast(stats.select("num_docs")))
    return terms.select("term", "df", "cf", bm25_idf(F.col("num_docs"), F.col("df")).alias("idf"), F.log10(F.col("num_docs") / F.col("df")).alias("tidf"))


def tfidf_weight(tf: Column, tidf: Column) -> Column:
    return (1 + F.log10(tf)) * tidf


def norms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, norm: the lengths of the documents' TF-IDF vectors; terms of every document weigh nothing."""
    w = postings.join(terms.where("tidf > 0").select("term", "tidf"), "term").select("doc_id", tfidf_weight(F.col("tf"), F.col("tidf")).alias("w"))
    return w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


#: Terms that norms_by_frequency() broadcasts.
COMMON = 200_000


def _least(terms: DataFrame, common: int) -> int:
    """A df that `common` terms at most are above."""
    n = 0
    for r in terms.groupBy("df").count().orderBy(F.desc("df")).collect():  # a row for each frequency that there is
        n += r["count"]
        if n > common:
            return r["df"]
    return 0


def norms_of_rows(docs: DataFrame, terms: DataFrame, common: int = COMMON) -> DataFrame:
    """norms() of docs(doc_id, terms, tfs): the `common` most frequent terms are weighed where the documents are, without a row for each; the others are joined."""
    least = _least(terms, common)
    rows = terms.where(F.col("df") > least).select("term", "tidf").toArrow().combine_chunks()
    sent = docs.sparkSession.sparkContext.broadcast(rows)

    def weighed(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array([], pa.string()) if not sent.value.num_rows else sent.value.column(0).combine_chunks()
        tidf = np.append(sent.value.column(1).to_numpy(), 0.0)
        for b in batches:
            for some in blocks._slices(b, 1, 500_000):
                flat, tfs = some.column(1).flatten(), some.column(2).flatten()
                code = pc.index_in(flat, known).fill_null(-1).to_numpy()  # -1: the 0 at the end
                doc = np.repeat(np.arange(some.num_rows), some.column(1).value_lengths().to_numpy())
                square = np.bincount(doc, ((1 + np.log10(tfs.to_numpy())) * tidf[code]) ** 2, some.num_rows)
                rest = pa.array(code < 0)
                ends = pa.array(np.append(0, np.cumsum(np.bincount(doc[code < 0], minlength=some.num_rows))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, x.filter(rest)) for x in (flat, tfs)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(square), *lists], ["doc_id", "square", "terms", "tfs"])
        blocks._release()

    known = stored(docs.select("doc_id", "terms", "tfs").mapInArrow(weighed, "doc_id string, square double, terms array<string>, tfs array<int>"))
    rest = known.select("doc_id", F.explode(F.arrays_zip("terms", "tfs")).alias("p")).select("doc_id", F.col("p.terms").alias("term"), F.col("p.tfs").alias("tf"))
    w = rest.join(terms.where((F.col("df") <= least) & (F.col("tidf") > 0)).select("term", "tidf"), "term").select("doc_id", tfidf_weight(F.col("tf"), F.col("tidf")).alias("w"))
    every = known.where("square > 0").select("doc_id", "square").union(w.select("doc_id", F.col("w") * F.col("w")))
    return every.groupBy("doc_id").agg(F.sqrt(F.sum("square")).alias("norm"))


def norms_by_frequency(postings: DataFrame, terms: DataFrame, common: int = COMMON) -> DataFrame:
    """norms(): the `common` most frequent terms are broadcast, so that their postings stay where they are; those of the others, a few of all, are shuffled."""
    least = _least(terms, common)
    known = postings.join(F.broadcast(terms.where(F.col("df") > least).select("term", "tidf")), "term", "left")
    rest = known.where("tidf is null").select("term", "doc_id", "tf").join(terms.where((F.col("df") <= least) & (F.col("tidf") > 0)).select("term", "tidf"), "term")
    w = known.where("tidf > 0").select("doc_id", "tf", "tidf").union(rest.select("doc_id", "tf", "tidf")).select("doc_id", tfidf_weight(F.col("tf"), F.col("tidf")).alias("w"))
    return w.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


def postings_lists(postings: DataFrame, term_stats: DataFrame, block: int = BLOCK) -> DataFrame:
    """term, block, docs, tfs: parallel arrays by doc_id, in blocks of about `block` documents of a term, dealt by the hash of the id.

    No row holds a whole list of a common term; a term of `block` documents or fewer is one row.
    """
    many = term_stats.select("term", F.ceil(F.col("df") / block).alias("many"))
    dealt = F.conv(F.substring(F.md5("doc_id"), 1, 7), 16, 10).cast("long") % F.col("many")
    packed = postings.join(many, "term").withColumn("block", dealt).groupBy("term", "block").agg(F.array_sort(F.collect_list(F.struct("doc_id", "tf"))).alias("p"))
    return packed.select("term", "block", F.col("p.doc_id").alias("docs"), F.col("p.tf").alias("tfs"))
