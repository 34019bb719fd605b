"""Corpus statistics: exact percentiles by index, extremes, vocabularies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def counts_by_value(lengths: DataFrame, column: str) -> DataFrame:
    """value, n: a length's histogram. It has as many rows as there are different lengths, so what follows is small for any corpus."""
    return lengths.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def percentiles(lengths: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each share p the value at index min(n - 1, int(n p)) of the sorted values; no value for an empty table."""
    hist = counts_by_value(lengths, column)
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    return upto.agg(*[F.min(F.when(F.col("upto") > F.least(F.col("total") - 1, F.floor(F.col("total") * F.lit(p))), F.col("value"))).alias(name) for name, p in shares.items()])


def median(lengths: DataFrame, column: str) -> DataFrame:
    """One row: the middle value, or the mean of the middle two."""
    hist = counts_by_value(lengths, column)
    w = Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    upto = hist.withColumn("upto", F.sum("n").over(w)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    low = F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) / 2), F.col("value")))
    high = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col("value")))
    return upto.agg(((low + high) / 2.0).alias("median"))


def lengths(rows: DataFrame) -> DataFrame:
    """doc_id, n (tokens), odd (an odd number of dollar signs) of rows(doc_id, text, tokens)."""
    dollars = F.length("text") - F.length(F.replace(F.col("text"), F.lit("$"), F.lit("")))
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n"), (F.coalesce(dollars, F.lit(0)) % 2 == 1).alias("odd"))


def corpus_stats(narrow: DataFrame, vocabulary: DataFrame, short: int = 10, long: int = 1000) -> DataFrame:
    """One row: lengths, empty, short and long texts, odd dollar signs, tokens, vocabulary, singletons.

    narrow: what lengths() gives, kept or written by the caller, as it is read three times; vocabulary(term, cf). Texts are tokenized for
    these two tables, and not again.
    """
    one = narrow.agg(
        F.count("*").alias("docs"), F.min("n").alias("min_tokens"), F.max("n").alias("max_tokens"), F.count_if(F.col("n") == 0).alias("empty"),
        F.count_if((F.col("n") > 0) & (F.col("n") < short)).alias("short"), F.count_if(F.col("n") > long).alias("long"), F.count_if("odd").alias("odd_dollars"), F.sum("n").alias("total_tokens"),
    )
    words = vocabulary.agg(F.count("*").alias("unique_tokens"), F.count_if(F.col("cf") == 1).alias("singletons"))
    return one.crossJoin(F.broadcast(median(narrow, "n").select(F.col("median").alias("median_tokens")))).crossJoin(F.broadcast(percentiles(narrow, "n", {"p90_tokens": 0.9}))).crossJoin(F.broadcast(words))


def short_examples(rows: DataFrame, short: int = 10, n: int = 5, preview: int = 100) -> DataFrame:
    """doc_id, preview: the first n texts, by id, of fewer than `short` tokens."""
    found = rows.where(F.size("tokens") < short)
    return found.orderBy("doc_id").limit(n).select("doc_id", F.substring("text", 1, preview).alias("preview"))


def run_shape(queries: DataFrame, run: DataFrame, depth: int = 100) -> DataFrame:
    """One row: queries, those without results, those with fewer than `depth`, and the mean number; with a column `seconds` in queries, the
    mean seconds of a query, too."""
    n = queries.join(run.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    seconds = [F.avg("seconds").alias("mean_seconds")] if "seconds" in queries.columns else []
    return n.agg(F.count("*").alias("queries"), F.count_if(F.col("n") == 0).alias("without_results"), F.count_if((F.col("n") > 0) & (F.col("n") < depth)).alias("with_few"), F.avg("n").alias("mean_results"), *seconds)


def top_tokens(rows: DataFrame, n: int = 50) -> DataFrame:
    return rows.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(n)


def longest(rows: DataFrame, n: int = 10, preview: int = 80) -> DataFrame:
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n_tokens"), F.substring("text", 1, preview).alias("preview")).orderBy(F.desc("n_tokens"), F.desc("doc_id")).limit(n)
