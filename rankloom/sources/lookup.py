"""Rows by id, without reading the others.

save() sorts rows by id over files and writes a table of the files' first and last ids beside them. A look-up opens only the files whose range holds a
wanted id, and within these the reader prunes row groups, which are small and sorted. The table has a row per file.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.readers import InputError

#: Bytes of a row group, about: what a look-up reads for one id.
GROUP = 1 << 20


def save(rows: DataFrame, path: str, key: str = "doc_id", files: int | None = None) -> None:
    """Rows of one string key each. Rows without a key are an error when they are written."""
    spark = rows.sparkSession
    n = files or max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.rdd.getNumPartitions())
    rows = rows.withColumn(key, F.coalesce(F.col(key), F.raise_error(F.lit("a row has no id")).cast("string")))
    rows.repartitionByRange(n, key).sortWithinPartitions(key).write.mode("overwrite").option("parquet.block.size", GROUP).parquet(f"{path}/rows")
    there = spark.read.parquet(f"{path}/rows").groupBy(F.input_file_name().alias("file"))
    there.agg(F.min(key).alias("first"), F.max(key).alias("last"), F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/files")


@dataclass
class Lookup:
    """What save() wrote. The table of files is read once."""

    spark: SparkSession
    path: str
    key: str = "doc_id"

    def __post_init__(self):
        self.files = sorted((r["first"], r["last"], r["file"]) for r in self.spark.read.parquet(f"{self.path}/files").collect())
        self.firsts = [f[0] for f in self.files]
        self.schema = self.spark.read.parquet(f"{self.path}/rows").schema

    def files_of(self, ids: list[str]) -> list[str]:
        """The files that can hold these ids."""
        found = set()
        for i in ids:
            k = bisect_right(self.firsts, i) - 1
            # equal keys may lie on both sides of a border
            while k >= 0 and self.files[k][1] >= i:
                found.add(self.files[k][2])
                k -= 1
        return sorted(found)

    def rows(self, ids: list[str], missing: bool = False) -> DataFrame:
        """The rows of some ids, as many as an interface asks for. An id that is not there is an error, unless `missing` ones are let go."""
        ids = sorted(set(ids))
        files = self.files_of(ids)
        found = self.spark.read.schema(self.schema).parquet(*files).where(F.col(self.key).isin(ids)) if files else self.spark.createDataFrame([], self.schema)
        if not missing:
            there = {r[0] for r in found.select(self.key).distinct().collect()}
            lost = [i for i in ids if i not in there]
            if lost:
                raise InputError(f"no rows for {len(lost)} ids: {lost[:5]}")
        return found
