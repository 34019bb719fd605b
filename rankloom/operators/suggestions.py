"""Title suggestions from an index of character n-grams, without a scan of all titles.

grams(gram, block, numbers): the titles, in file order and in blocks of BLOCK numbers, whose lower-cased text has the gram, one to three characters long. A
text's trigrams (or itself, if it is shorter) are looked up block after block, from the first; titles that have them all are fetched and verified, and
the search ends with the block that has enough. A gram that every title has is a row in each block, no longer list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Numbers of a block; blocks that the first look-up takes, twice as many each time; titles that one look-up fetches.
BLOCK, FIRST_BLOCKS = 65_536, 4
SIZES = (1, 2, 3)


@dataclass
class Suggestions:
    grams: DataFrame
    titles: DataFrame
    block: int = BLOCK

    def save(self, path: str) -> None:
        """Grams sorted by gram and block, titles by number: a reader prunes row groups by either."""
        n = int(self.grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        self.grams.repartitionByRange(n, "gram", "block").sortWithinPartitions("gram", "block").write.mode("overwrite").parquet(f"{path}/grams")
        self.titles.repartitionByRange(n, "number").sortWithinPartitions("number").write.mode("overwrite").parquet(f"{path}/titles")

    def suggest(self, text: str, n: int = 5, prefix_first: bool = False) -> DataFrame:
        """The first n rows of titles that hold the text, without regard to case; none for blank text. prefix_first: those that begin with it before the others."""
        needle = text.strip().lower()
        if not needle or n < 1:
            return self.titles.limit(0)
        if not prefix_first:
            return self.titles.sparkSession.createDataFrame(self._found(needle, n), self.titles.schema)
        begins = self._found(needle, n, True)
        others = [] if len(begins) == n else [r for r in self._found(needle, n + len(begins)) if r["number"] not in {b["number"] for b in begins}]
        return self.titles.sparkSession.createDataFrame((begins + others)[:n], self.titles.schema)

    def _found(self, needle: str, n: int, prefix: bool = False) -> list:
        grams = sorted({needle[k : k + 3] for k in range(len(needle) - 2)}) or [needle]
        lists = self.grams.where(F.col("gram").isin(grams))
        last = lists.agg(F.max("block")).first()[0]
        found: list = []
        begin, step = 0, FIRST_BLOCKS
        title = F.lower("title")
        while last is not None and begin <= last and len(found) < n:
            some = lists.where(F.col("block").between(begin, begin + step - 1))
            # numbers that all grams have, block by block: at most a block's numbers
            by_block = some.groupBy("block").agg(F.collect_list("numbers").alias("lists")).where(F.size("lists") == len(grams))
            every = F.aggregate("lists", F.get("lists", F.lit(0)), F.array_intersect)
            numbers = by_block.select(F.explode(every).alias("number"))
            low, high = begin * self.block, (begin + step) * self.block - 1
            rows = self.titles.where(F.col("number").between(low, high)).join(numbers, "number", "left_semi")
            rows = rows.where(F.startswith(title, F.lit(needle)) if prefix else F.contains(title, F.lit(needle)))
            found += rows.orderBy("number").limit(n - len(found)).collect()
            begin, step = begin + step, step * 2
        return found


def build(titles: DataFrame, block: int = BLOCK) -> Suggestions:
    """titles(number long from 0 on, title, ...). Null titles are never found. Save or cache the index; it serves all texts."""
    t = F.lower("title")

    def grams(k: int):
        every = F.transform(F.sequence(F.lit(1), F.length(t) - (k - 1)), lambda i: F.substring(t, i, F.lit(k)))
        return F.when(F.length(t) >= k, every).otherwise(F.array().cast("array<string>"))

    rows = titles.where(F.col("title").isNotNull()).select(F.col("number").cast("long").alias("number"), F.explode(F.array_distinct(F.concat(*map(grams, SIZES)))).alias("gram"))
    lists = rows.groupBy("gram", F.floor(F.col("number") / block).alias("block")).agg(F.array_sort(F.collect_list("number")).alias("numbers"))
    return Suggestions(lists, titles.withColumn("number", F.col("number").cast("long")), block)


def load(spark: SparkSession, path: str, block: int = BLOCK) -> Suggestions:
    return Suggestions(spark.read.parquet(f"{path}/grams"), spark.read.parquet(f"{path}/titles"), block)
