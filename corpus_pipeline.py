"""The corpus pipeline: documents go through STAGES in order, each written as Parquet and read again as the next one's input.

1 quality rules (rejected documents go), 2 near-dedup by five-word shingles (one document of each group stays), 3 benchmark decontamination (documents
that hold a benchmark item go), 4 mixing sources to target weights (documents are left out or repeated), 5 sharding (every row gets its
place). All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rankloom.llm import decontamination, mixing, quality, sharding, simhash
from rankloom.llm.common import table, work_dir, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs, by_similarity=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: Forests, fingerprint components and template windows are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents: a row for each document of the mix, as often as it takes it, with its shard and its place there.

    Rows with null, empty or short texts go in the first stage; repeated rows are one near-duplicate group, of which one row stays; null ids
    are ids; an empty table, or one that loses all rows, gives an empty result; empty labels and benchmark tables reject nothing.
    """
    path = work_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{path}/{k}_{name}")
    return docs
