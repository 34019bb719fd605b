"""Collections: documents to papers and paragraphs, their metadata and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions.stem import stem_arrays


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paper_id, pos, text: a row per line of a document, ids <paper>_<n> with n from 1."""
    lines = docs.select(F.col("doc_id").cast("string").alias("paper_id"), F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    return lines.select(F.concat_ws("_", "paper_id", (F.col("p") + 1).cast("string")).alias("doc_id"), "paper_id", (F.col("p") + 1).cast("long").alias("pos"), "text")


def paragraphs_of_raw(papers: DataFrame) -> DataFrame:
    """The same from raw papers, whose paragraphs are a map: ordered by the number that ends each id."""
    rows = papers.select("paper_id", "title", F.explode("paragraphs").alias("doc_id", "text"))
    return rows.withColumn("pos", F.regexp_extract("doc_id", r"_(\d+)$", 1).cast("long"))


def tokenized(rows: DataFrame, cfg: T.Tokenizing = T.Tokenizing(), cleaning: T.Cleaning | None = None, column: str = "text") -> DataFrame:
    return rows.withColumn("tokens", T.tokenize(F.col(column), cfg, cleaning))


def non_empty(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("tokens") > 0)


def empty(rows: DataFrame) -> DataFrame:
    return rows.where(F.size("tokens") == 0)


def paper_collection(papers: DataFrame, cfg: T.Tokenizing = T.Tokenizing(), title_weight: int = 1, paragraph_title: bool = False, cleaning: T.Cleaning | None = None) -> tuple[DataFrame, DataFrame]:
    """(papers, paragraphs) of raw papers with tokens. A paper's tokens are its title's, title_weight times, and those of its non-empty
    paragraphs in order; the abstract is paragraph 1. With paragraph_title, paragraphs begin with the title's tokens, too."""
    words = lambda t: T.words(t, cfg, cleaning)
    pos = lambda key: F.regexp_extract(key, r"_(\d+)$", 1).cast("long")
    # a paper's paragraphs are in its row, and stay there
    own = F.array_sort(F.transform(F.map_entries("paragraphs"), lambda e: F.struct(pos(e["key"]).alias("pos"), words(e["value"]).alias("own"))))
    body = F.coalesce(F.flatten(F.transform(own, lambda x: x["own"])), F.array().cast("array<string>"))
    whole = papers.select(F.col("paper_id").alias("doc_id"), "title", "abstract", T.paper_year(F.col("paper_id")).alias("year"), F.concat(F.flatten(F.array_repeat(words(F.col("title")), title_weight)), body).alias("tokens"))
    whole = whole.withColumn("tokens", stem_arrays(F.col("tokens"), cfg.stemming))
    parts = paragraphs_of_raw(papers).withColumn("own", T.tokenize(F.col("text"), cfg, cleaning)).where(F.size("own") > 0).withColumn("t", T.tokenize(F.col("title"), cfg, cleaning))
    tokens = F.concat("t", "own") if paragraph_title else F.col("own")
    return non_empty(whole), parts.select("doc_id", "paper_id", "text", tokens.alias("tokens"))


def metadata(papers: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, title, abstract, year: an empty or missing abstract is paragraph 1. papers: doc_id, title, abstract, year."""
    first = parts.where(F.col("doc_id").endswith("_1")).select(F.col("doc_id").alias("pid"), F.col("text").alias("first"))
    joined = papers.join(first, F.concat(papers["doc_id"], F.lit("_1")) == F.col("pid"), "left")
    return joined.select("doc_id", "title", F.coalesce(F.nullif(F.col("abstract"), F.lit("")), "first", F.lit("")).alias("abstract"), "year")


def manifest(papers: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: papers and paragraphs, the empty ones, and tokens, in one pass over each."""
    n = F.size("tokens")
    a = papers.agg(F.count("*").alias("papers_read"), F.count_if(n > 0).alias("papers"), F.count_if(n == 0).alias("empty_papers"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("paper_tokens"))
    b = parts.agg(F.count("*").alias("paragraphs_read"), F.count_if(n > 0).alias("paragraphs"), F.count_if(n == 0).alias("empty_paragraphs"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("paragraph_tokens"))
    return a.crossJoin(F.broadcast(b))


def texts(papers: DataFrame, parts: DataFrame, collection: str, cleaning: T.Cleaning | None = None, with_title: bool = False) -> DataFrame:
    """doc_id, text of a collection for an encoder: papers are title and abstract, paragraphs their own text, after its title if wanted.

    papers(doc_id, title, abstract), parts(doc_id, paper_id, text). What is empty after cleaning drops out.
    """
    if collection == "paper":
        rows = papers.select("doc_id", T.title_and_abstract(F.col("title"), F.col("abstract")).alias("text"))
    elif collection == "paragraph":
        own = T.clean_for_encoder(F.col("text"), cleaning) if cleaning else F.col("text")
        rows = parts.select("doc_id", "paper_id", own.alias("text")).where(F.trim("text") != "")
        if with_title:
            heads = papers.select(F.col("doc_id").alias("paper_id"), "title")
            rows = rows.join(heads, "paper_id", "left").withColumn("text", T.title_and_text(F.col("title"), F.col("text")))
        rows = rows.select("doc_id", "text")
    else:
        raise ValueError(f"unknown collection {collection!r}")
    return rows.where(F.trim("text") != "")


def neural_collection(papers: DataFrame, parts: DataFrame, cleaning: T.Cleaning = T.Cleaning()) -> DataFrame:
    """doc_id, paper_id, title, text of the paragraphs whose cleaned text is not empty."""
    rows = parts.select("doc_id", "paper_id", T.clean_for_encoder(F.col("text"), cleaning).alias("text")).where("text <> ''")
    return rows.join(papers.select(F.col("doc_id").alias("paper_id"), "title"), "paper_id", "left").select("doc_id", "paper_id", F.coalesce("title", F.lit("")).alias("title"), "text")
