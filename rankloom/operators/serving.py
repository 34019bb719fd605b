"""What a search page shows: results, excerpts, suggestions, facets, history, saved documents."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.functions import text as T
from rankloom.functions.stem import stem_arrays
from rankloom.operators.ranking import page, small


def excerpt(rows: DataFrame, cfg: T.Tokenizing = T.Tokenizing(), length: int = 300) -> DataFrame:
    """rows(text, query) with excerpt: the sentence that shares most tokens with the query, the first of equals, cut at `length`."""
    rows = rows.withColumn("__s", T.sentences(F.col("text"))).withColumn("__q", T.tokenize(F.col("query"), cfg))
    rows = rows.withColumn("__t", stem_arrays(F.transform("__s", lambda s: T.words(s, cfg)), cfg.stemming, 2))
    shared = F.transform("__s", lambda s, i: F.struct((-F.size(F.array_intersect(F.get("__t", i), F.col("__q")))).alias("n"), i.alias("i"), s.alias("s")))
    return rows.withColumn("excerpt", T.truncate(F.array_min(shared)["s"], length)).drop("__q", "__s", "__t")


def results_page(run: DataFrame, metadata: DataFrame, queries: DataFrame, number: int = 1, size: int = 10, depth: int = 100) -> DataFrame:
    """A page of the first `depth` hits with total, metadata and excerpt; hits without metadata drop out. metadata(doc_id, title, text)."""
    top = run.where(F.col("rank") <= depth)
    total = top.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = small(page(top, number, size).join(total, "query_id").join(queries.select("query_id", "query"), "query_id")).join(metadata, "doc_id")
    return excerpt(rows).select("query_id", "rank", "doc_id", "score", "total", "title", "excerpt")


def facet_filter(rows: DataFrame, types: list[str] | None = None, since: int | None = None, type_column: str = "type", year_column: str = "year") -> DataFrame:
    rows = rows.where(F.col(type_column).isin(*types)) if types else rows
    return rows.where(F.col(year_column) >= since) if since is not None else rows


def suggest(titles: DataFrame, text: str, n: int = 5, prefix_first: bool = False) -> DataFrame:
    """The first n rows of titles(number, title) that hold the text, without regard to case; none for blank text."""
    needle = text.strip().lower()
    if not needle:
        return titles.limit(0)
    found = titles.where(F.contains(F.lower("title"), F.lit(needle)))
    order = [F.startswith(F.lower("title"), F.lit(needle)).desc()] if prefix_first else []
    return found.orderBy(*order, "number").limit(n)


def query_vocabulary(queries: DataFrame, cfg: T.Tokenizing = T.Tokenizing()) -> DataFrame:
    """query_id, word, pos: a query's distinct words, as written, that leave a token; by first place."""
    words = F.array_distinct(F.filter(F.split(F.col("query"), f"[{T.SPACE}]+"), lambda w: w != ""))
    kept = F.filter(words, lambda w: F.size(T.words(w, cfg)) > 0)
    return queries.select("query_id", F.posexplode(kept).alias("pos", "word")).select("query_id", "word", F.col("pos").cast("long").alias("pos"))


def merge_vocabulary(words: DataFrame, state: DataFrame) -> DataFrame:
    """words(word) with `active` from state(word, active), by lower-cased word; new words are active."""
    old = state.groupBy(F.lower("word").alias("__k")).agg(F.max("active").alias("was"))
    return words.join(old, F.lower("word") == F.col("__k"), "left").select("word", F.coalesce("was", F.lit(True)).alias("active"))


def history_by_day(history: DataFrame) -> DataFrame:
    return history.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def recent(history: DataFrame, n: int = 100, by: str = "user_id") -> DataFrame:
    w = Window.partitionBy(by).orderBy(F.desc("ts"), F.desc("event_id"))
    return history.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def clear_day(history: DataFrame, day: Column) -> DataFrame:
    return history.where(F.to_date("ts") != day)


def dedupe_saved(saved: DataFrame, keys: list[str], newest: Column) -> DataFrame:
    """One row per key, the newest."""
    w = Window.partitionBy(*keys).orderBy(newest)
    return saved.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def page_buttons(current: int, total: int, shown: int = 5) -> list[int]:
    """The page numbers to offer: `shown` of them around the current one, within 1 and total."""
    first = max(1, min(current - shown // 2, total - shown + 1))
    return list(range(first, min(total, first + shown - 1) + 1))


def page_range(current: Column, total: Column, shown: int = 5) -> list[Column]:
    """page_buttons() of columns: first and last."""
    first = F.greatest(F.lit(1), F.least(current - shown // 2, total - shown + 1))
    return [first.alias("first"), F.least(total, first + shown - 1).alias("last")]


def active_filters(types: list[str] | None, since: int | None) -> int:
    return len(types or []) + (since is not None)


def saved_valid(rows: DataFrame) -> DataFrame:
    """Saved collections that have an id, a name and whole documents."""
    ok = F.forall("documents", lambda d: d["id"].isNotNull() & d["result"].isNotNull() & d["savedAt"].isNotNull())
    return rows.where("id is not null and trim(name) <> '' and documents is not null").where(ok)


def save_document(saved: DataFrame, new: DataFrame) -> DataFrame:
    """saved(name, doc_id, collection, saved_at) with new ones; of one name (in any letter case), document and collection, the newest."""
    every = saved.unionByName(new).withColumn("__name", F.lower(F.trim("name")))
    return dedupe_saved(every, ["__name", "doc_id", "collection"], F.desc("saved_at")).drop("__name")


class NotFound(LookupError):
    """A document that is not there: what an interface answers with 404."""


def document(doc_id: str, metadata: DataFrame, parts: DataFrame, collection: str = "paper") -> DataFrame:
    """One row doc_id, type, title, year, content: a paper's abstract or a paragraph's text. NotFound for an id that the collection lacks, or
    whose paper has no metadata. metadata(doc_id, title, abstract, year), parts(doc_id, paper_id, text). Both are filtered by id, so that
    a reader prunes row groups."""
    if collection not in ("paper", "paragraph"):
        raise ValueError(f"unknown collection {collection!r}")
    if collection == "paper":
        rows = metadata.where(F.col("doc_id") == doc_id).select("doc_id", F.lit("Paper").alias("type"), "title", "year", F.col("abstract").alias("content"))
    else:
        own = parts.where(F.col("doc_id") == doc_id).select("doc_id", "paper_id", F.col("text").alias("content"))
        heads = metadata.select(F.col("doc_id").alias("paper_id"), "title", "year")
        rows = own.join(heads, "paper_id").select("doc_id", F.lit("Paragraph").alias("type"), "title", "year", "content")
    if rows.limit(1).count() == 0:
        raise NotFound(doc_id)
    return rows


#: What an interface offers.
MODELS, COLLECTIONS = ("bm25", "tfidf"), ("paper", "paragraph")


def health() -> dict:
    return {"status": "ok", "models": list(MODELS), "collections": list(COLLECTIONS)}


def preferences(stored: dict | None) -> dict:
    """model and collection of stored preferences; what is missing or unknown is the first one."""
    stored = stored if isinstance(stored, dict) else {}
    pick = lambda key, known: stored.get(key) if stored.get(key) in known else known[0]
    return {"model": pick("model", MODELS), "collection": pick("collection", COLLECTIONS)}


def search(ranked: DataFrame, metadata: DataFrame, parts: DataFrame | None, queries: DataFrame, collection: str = "paper", number: int = 1, size: int = 10, depth: int = 100, types: list[str] | None = None, since: int | None = None) -> DataFrame:
    """query_id, rank, doc_id, type, year, title, excerpt, total of a page of the first `depth` hits.

    A paragraph's paper is found over parts(doc_id, paper_id, text), its title and year over metadata(doc_id, title, abstract, year); hits
    without metadata drop out of the page, not out of the total. With facets (types, since a year), hits that have not those are left out before
    pages are cut: total and rank are those of what is left.
    """
    top, kind = ranked.where(F.col("rank") <= depth), "Paper" if collection == "paper" else "Paragraph"
    if types or since is not None:
        heads = metadata.select("doc_id", "year")
        if collection != "paper":
            heads = parts.select("doc_id", "paper_id").join(small(top.select("doc_id").distinct()), "doc_id", "left_semi").join(heads.withColumnRenamed("doc_id", "paper_id"), "paper_id").select("doc_id", "year")
        top = facet_filter(top.join(heads, "doc_id").withColumn("type", F.lit(kind)), types, since).drop("type", "year")
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    total = top.groupBy("query_id").agg(F.count("*").alias("total"))
    rows = page(top, number, size).join(total, "query_id").join(queries.select("query_id", "query"), "query_id")
    rows = small(rows)  # a page of hits goes to the texts, not the texts to it
    if collection == "paper":
        rows = rows.join(metadata.withColumnRenamed("abstract", "text"), "doc_id")
    else:
        rows = small(rows.join(parts.select("doc_id", "paper_id", "text"), "doc_id").persist(StorageLevel.MEMORY_AND_DISK)).join(metadata.select(F.col("doc_id").alias("paper_id"), "title", "year"), "paper_id")
    return excerpt(rows).select("query_id", "rank", "doc_id", F.lit(kind).alias("type"), "year", "title", "excerpt", "total")


# --- a user's vocabulary: words(word, kind, active), kind query, keyword or suggested ---


def vocabulary_state(query_words: DataFrame, state: DataFrame) -> DataFrame:
    """word, kind, active after a new query: its words, as they were switched before (new ones on), and the user's own keywords."""
    fresh = merge_vocabulary(query_words.select("word").distinct(), state.select("word", "active")).select("word", F.lit("query").alias("kind"), "active")
    own = state.where("kind <> 'query'").withColumn("__k", F.lower("word"))
    rest = own.join(fresh.select(F.lower("word").alias("__k")), "__k", "left_anti").select("word", "kind", "active")
    return fresh.unionByName(rest)


def toggle(state: DataFrame, word: str) -> DataFrame:
    return state.withColumn("active", F.when(F.lower("word") == word.strip().lower(), ~F.col("active")).otherwise(F.col("active")))


def add_keyword(state: DataFrame, word: str) -> DataFrame:
    """The state with a keyword; blank ones and those that are there, in any letter case, change nothing but that they are on."""
    key = word.strip().lower()
    if not key:
        return state
    there = F.lower("word") == key
    known = state.where(there).limit(1).count() > 0
    on = state.withColumn("active", F.col("active") | there)
    return on if known else on.unionByName(state.sparkSession.createDataFrame([(word.strip(), "keyword", True)], "word string, kind string, active boolean"))


def remove_keyword(state: DataFrame, word: str) -> DataFrame:
    return state.where((F.lower("word") != word.strip().lower()) | (F.col("kind") == "query"))


def reset(state: DataFrame) -> DataFrame:
    """All words on, without the user's own."""
    return state.where("kind = 'query'").withColumn("active", F.lit(True))


def active_words(state: DataFrame) -> list[str]:
    """The words to highlight."""
    return [r["word"] for r in state.where("active").select("word").distinct().orderBy("word").collect()]


# --- history(event_id, user_id, query, ts) ---


def add_search(history: DataFrame, new: DataFrame, keep: int = 100, by: str = "user_id") -> DataFrame:
    """The history with new entries, newest first, `keep` of each user; blank queries are not kept."""
    every = history.unionByName(new.where(F.trim("query") != ""))
    return recent(every, keep, by).drop("place")


def remove_search(history: DataFrame, ids: DataFrame) -> DataFrame:
    return history.join(ids.select("event_id"), "event_id", "left_anti")


def clear_history(history: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """Without the entries of these users, or of all."""
    return history.limit(0) if users is None else history.join(users.select("user_id"), "user_id", "left_anti")


def remove_saved(saved: DataFrame, name: str, doc_id: str, collection: str) -> DataFrame:
    """saved(name, doc_id, collection, saved_at) without one document of a collection of that name, in any letter case."""
    gone = (F.lower(F.trim("name")) == name.strip().lower()) & (F.col("doc_id") == doc_id) & (F.col("collection") == collection)
    return saved.where(~gone)


def delete_saved(saved: DataFrame, name: str) -> DataFrame:
    return saved.where(F.lower(F.trim("name")) != name.strip().lower())
