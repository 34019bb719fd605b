"""Operator 3, line dedup by winnowing over line hashes, in DataFrame functions only.

Lines that have a word are hashed. A window of a line is the shortest run of lines from it on that has at least `min_words` words; of each
window, the line with the least hash is selected. Two copies of a run of min_words words hold a whole window, hence select the same
line: selected lines are guaranteed fingerprints. Fingerprints that occur once are dropped. Around the others, matches are extended both
ways, window by window: the windows that begin at, and those that end at, each line near a fingerprint are joined by their content, and
all but the first occurrence of a window are repeats (a window's content is known by 128 bits of independent hashes of its lines). Their lines are what is deleted, exactly the lines of every run of min_words words
or more that has occurred before. Each content's first place is a partial aggregate: a line that is in most documents makes no large task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.llm.common import WORD, table, work_dir, written

#: Words that a run needs, in all, to be deleted when it occurs again.
MIN_WORDS = 25


def _lines(text: Column) -> Column:
    """array<struct<line, h, g, w>> of a text's lines that have a word: number among all lines, two hashes with different seeds, words."""
    each = F.transform(F.split(text, "\n", -1), lambda s, i: F.struct(i.cast("int").alias("line"), F.xxhash64(s).alias("h"), F.xxhash64(F.lit("g"), s).alias("g"), F.regexp_count(s, F.lit(WORD)).alias("w")))
    return F.filter(each, lambda x: x["w"] > 0)


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, line, h, g, w, c0, c1 (words before, and up to the end of, the line) per line with a word of each distinct row.

    Rows that repeat both doc_id and text are one document.
    """
    per_doc = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _lines(F.col("text").cast("string")).alias("lines")).where(F.size("lines") > 0)
    per_doc = per_doc.groupBy("doc_id", "text_key").agg(F.first("lines").alias("lines"))
    upto = Window.partitionBy("doc_id", "text_key").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    rows = per_doc.select("doc_id", "text_key", F.inline("lines")).withColumn("c1", F.sum("w").over(upto).cast("long"))
    return rows.withColumn("c0", F.col("c1") - F.col("w"))


def repeated_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, lines, deleted (the numbers, from 0, of the lines to delete, in order), per distinct row that has a word.

    Places are ordered by doc_id (null first), text_key, line; the first of equal runs stays. Runs within one document count as well.
    """
    spark = docs.sparkSession
    path = work_dir(spark)
    lines = written(line_table(docs), f"{path}/lines")
    doc = ["doc_id", "text_key"]
    # lines that begin less than min_words words after this one begins: the shortest run that has so many words
    ahead = Window.partitionBy(*doc).orderBy("c0").rangeBetween(0, min_words - 1)
    back = Window.partitionBy(*doc).orderBy("c1").rangeBetween(-(min_words - 1), 0)
    picked = lines.select(*doc, F.when(F.sum("w").over(ahead) >= min_words, F.min(F.struct("h", "line")).over(ahead)).alias("p")).where("p is not null").select(*doc, "p.h", "p.line").distinct()
    picked = written(picked, f"{path}/picked")
    common = picked.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    anchors = picked.join(common, "h").select(*[F.col(c).alias(f"a_{c}") for c in doc], F.col("line").alias("a_line"))
    near = lines.join(anchors, F.col("doc_id").eqNullSafe(F.col("a_doc_id")) & (F.col("text_key") == F.col("a_text_key")) & (F.col("line") == F.col("a_line")), "left")
    near = near.select(*doc, "line", "h", "g", "w", "c0", "c1", F.col("a_line").isNotNull().cast("int").alias("anchor"))

    def windows(frame, side: int) -> DataFrame:
        found = near.select(*doc, "line", F.collect_list(F.struct("h", "g")).over(frame).alias("hs"), F.min("line").over(frame).alias("first"), F.max("line").over(frame).alias("last"), F.sum("w").over(frame).alias("ws"), F.max("anchor").over(frame).alias("near"))
        found = found.where((F.col("ws") >= min_words) & (F.col("near") == 1))
        return found.select(*doc, "first", "last", F.lit(side).alias("side"), F.xxhash64("hs.h").alias("k1"), F.xxhash64("hs.g").alias("k2"))

    # a window that begins at a line and one that ends at a line may have the same content; each kind is joined with its own
    places = written(windows(ahead, 0).union(windows(back, 1)), f"{path}/windows")
    place = F.struct("doc_id", "text_key", "first")
    firsts = places.groupBy("side", "k1", "k2").agg(F.min(place).alias("origin"), F.count("*").alias("n")).where("n > 1")
    again = places.join(firsts, ["side", "k1", "k2"]).where(~place.eqNullSafe(F.col("origin")))
    gone = again.select(*doc, F.explode(F.sequence("first", "last")).alias("g_line")).distinct().select(*[F.col(c).alias(f"g_{c}") for c in doc], "g_line")
    marked = lines.join(gone, F.col("doc_id").eqNullSafe(F.col("g_doc_id")) & (F.col("text_key") == F.col("g_text_key")) & (F.col("line") == F.col("g_line")), "left")
    return marked.groupBy(*doc).agg(F.count("*").alias("lines"), F.array_sort(F.collect_list(F.col("g_line"))).alias("deleted"), F.sum(F.when(F.col("g_line").isNotNull(), F.col("w")).otherwise(F.lit(0))).cast("long").alias("words_deleted"))


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of docs, with all their columns, without the lines that repeated_lines deletes. Null texts stay null, empty ones empty; rows
    that repeat both id and text are one document and lose the same lines; an empty table stays empty."""
    found = repeated_lines(docs, min_words).where("size(deleted) > 0").select(F.col("doc_id").alias("__rl_id"), F.col("text_key").alias("__rl_key"), F.col("deleted").alias("__rl_deleted"))
    out = docs.join(found, docs["doc_id"].eqNullSafe(F.col("__rl_id")) & (F.xxhash64(docs["text"]) == F.col("__rl_key")), "left")
    kept = F.filter(F.split("text", "\n", -1), lambda s, i: ~F.array_contains(F.col("__rl_deleted"), i.cast("int")))
    return out.withColumn("text", F.when(F.col("__rl_deleted").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).select(*docs.columns)


def summarise(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_lines (with a word), n_deleted, words_deleted, deleted (line numbers from 0, comma-joined) per row of docs(doc_id, text).

    Null and empty texts, and texts of blank lines, have no lines and lose none; blank lines never count and never go. Rows that repeat
    both id and text are one document given more than once and have the same result; other rows with one id are told apart by their
    texts. An empty table gives an empty result; other columns are not looked at.
    """
    found = repeated_lines(docs, min_words).select(F.col("doc_id").alias("f_id"), "text_key", "lines", "deleted", "words_deleted")
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("key") == F.col("text_key")), "left")
    return out.select("doc_id", F.coalesce("lines", F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("deleted"), F.lit(0)).cast("long").alias("n_deleted"), F.coalesce("words_deleted", F.lit(0)).cast("long").alias("words_deleted"), F.coalesce(F.array_join("deleted", ","), F.lit("")).alias("deleted"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(table(spark, sf_dir, "documents"))


SQL = f"""
WITH t AS (SELECT doc_id, text FROM documents GROUP BY doc_id, text),
s AS (SELECT doc_id, text, str_split(text, chr(10)) AS parts FROM t),
l AS (SELECT doc_id, text, unnest(parts) AS s, CAST(unnest(range(len(parts))) AS BIGINT) AS line FROM s),
w AS (SELECT *, len(regexp_extract_all(s, '[^ \\t-\\r]+')) AS w FROM l),
c AS (SELECT *, CAST(sum(w) OVER (PARTITION BY doc_id, text ORDER BY line) AS BIGINT) AS c1 FROM w WHERE w > 0),
x AS (SELECT doc_id, text, line, s, w, c1, c1 - w AS c0 FROM c),
f AS (SELECT doc_id, text, 0 AS side, list(s) OVER a AS body, min(line) OVER a AS first, max(line) OVER a AS last, sum(w) OVER a AS ws FROM x
  WINDOW a AS (PARTITION BY doc_id, text ORDER BY c0 RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)),
b AS (SELECT doc_id, text, 1 AS side, list(s) OVER a AS body, min(line) OVER a AS first, max(line) OVER a AS last, sum(w) OVER a AS ws FROM x
  WINDOW a AS (PARTITION BY doc_id, text ORDER BY c1 RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)),
u AS (SELECT * FROM f WHERE ws >= {MIN_WORDS} UNION ALL SELECT * FROM b WHERE ws >= {MIN_WORDS}),
r AS (SELECT *, row_number() OVER (PARTITION BY side, body ORDER BY doc_id NULLS FIRST, text, first) AS n FROM u),
g AS (SELECT DISTINCT doc_id, text, unnest(range(first, last + 1)) AS line FROM r WHERE n > 1),
d AS (SELECT x.doc_id, x.text, count(*) AS n_lines, count(g.line) AS n_deleted, CAST(coalesce(sum(x.w) FILTER (WHERE g.line IS NOT NULL), 0) AS BIGINT) AS words_deleted,
  coalesce(string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY g.line) FILTER (WHERE g.line IS NOT NULL), '') AS deleted
  FROM x LEFT JOIN g ON x.doc_id IS NOT DISTINCT FROM g.doc_id AND x.text = g.text AND x.line = g.line GROUP BY x.doc_id, x.text)
SELECT o.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted, coalesce(words_deleted, 0) AS words_deleted, coalesce(deleted, '') AS deleted
FROM documents o LEFT JOIN d ON o.doc_id IS NOT DISTINCT FROM d.doc_id AND o.text = d.text
"""
