"""Registry of the engine's queries and of their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankloom.functions import encoders, stem
from rankloom.functions import text as T
from rankloom.operators import blocks
from rankloom.operators import collections as C
from rankloom.operators import index as I
from rankloom.operators import metrics as M
from rankloom.operators import ranking as R
from rankloom.operators import serving as V
from rankloom.operators import stats as S
from rankloom.operators import suggestions
from rankloom.operators import tuning as U
from rankloom.plans import fixtures as X
from rankloom.plans import sql as Q
from rankloom.sources import readers, writers

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, extra: dict[str, str] | None = None, name: str | None = None):
    """Registers a query with the SQL that gives the same rows."""

    def add(f):
        key = name or f.__name__
        _QUERIES[key] = f
        if sql is not None:
            _SQL[key] = Q.build(sql, extra)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    """Further modules register their queries when they are imported."""
    import rankloom.plans.storage  # noqa: F401


def rounded(df: DataFrame, n: int = 6) -> DataFrame:
    """Doubles to n places, as sums depend on their order beyond that."""
    return df.select(*[F.round(c, n).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def longs(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return X.table(spark, d, "documents")


# --- text ---

MATH_TAIL, URL_TAIL, CITE_TAIL = r" tail $x_1$ and \alpha costs", " see https://a.b/c?d=1, or www.x.org now", " as in [1, 2–3] and [ 7 ] but [a1] [3-]"


def _with_tail(spark: SparkSession, d: str, tail: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", F.concat("text", F.lit(tail)).alias("t"))


SQL_MATH = r"regexp_replace(CASE WHEN (length({t}) - length(replace({t}, '$', ''))) % 2 = 0 THEN regexp_replace({t}, '\$[^$]*\$', ' ', 'g') ELSE {t} END, '\\[a-zA-Z]+', ' ', 'g')"
SQL_URL = rf"regexp_replace({{t}}, 'https?://[^{Q.SP}]+|www\.[^{Q.SP}]+', ' ', 'g')"
SQL_CITE = rf"regexp_replace({{t}}, '\[[{Q.SP}]*\p{{{{Nd}}}}+(?:[{Q.SP}]*[,–-][{Q.SP}]*\p{{{{Nd}}}}+)*[{Q.SP}]*\]', ' ', 'g')".replace(Q.SP, Q.SP.replace("{", "{{").replace("}", "}}"))
SQL_URL = SQL_URL.replace(Q.SP, Q.SP.replace("{", "{{").replace("}", "}}"))


@query(f"SELECT doc_id, {SQL_MATH.format(t='t')} AS cleaned FROM (SELECT doc_id, text || '{MATH_TAIL}' AS t FROM documents)")
def clean_math(spark, d):
    return _with_tail(spark, d, MATH_TAIL).select("doc_id", T.clean_math(F.col("t")).alias("cleaned"))


@query(f"SELECT doc_id, {SQL_URL.format(t='t')} AS cleaned FROM (SELECT doc_id, text || '{URL_TAIL}' AS t FROM documents)")
def clean_urls(spark, d):
    return _with_tail(spark, d, URL_TAIL).select("doc_id", T.clean_urls(F.col("t")).alias("cleaned"))


@query(f"SELECT doc_id, {SQL_CITE.format(t='t')} AS cleaned FROM (SELECT doc_id, text || '{CITE_TAIL}' AS t FROM documents)")
def clean_citations(spark, d):
    return _with_tail(spark, d, CITE_TAIL).select("doc_id", T.clean_citations(F.col("t")).alias("cleaned"))


ENCODER_TAIL = MATH_TAIL + URL_TAIL + CITE_TAIL + " ( ) end ."
_STEP1 = SQL_CITE.format(t=SQL_URL.format(t=SQL_MATH.format(t="t")))
_STEP2 = rf"regexp_replace({_STEP1}, '\([{Q.SP}]*\)|\[[{Q.SP}]*\]', ' ', 'g')"
_STEP3 = rf"trim(regexp_replace(regexp_replace({_STEP2}, '[{Q.SP}]', ' ', 'g'), '[{Q.SP}]+([.,;:!?)\]])', '\1', 'g'))"


@query(f"SELECT doc_id, {_STEP3} AS cleaned FROM (SELECT doc_id, text || '{ENCODER_TAIL}' AS t FROM documents)")
def clean_for_encoder(spark, d):
    return _with_tail(spark, d, ENCODER_TAIL).select("doc_id", T.clean_for_encoder(F.col("t")).alias("cleaned"))


@query("SELECT doc_id, tokens FROM papers_s")
def tokenize(spark, d):
    return X.paper_tokens(spark, d).select("doc_id", "tokens")


@query("SELECT doc_id, tokens FROM papers")
def tokenize_unstemmed(spark, d):
    return X.papers(spark, d).select("doc_id", T.tokenize(F.col("text"), T.UNSTEMMED).alias("tokens"))


@query(rf"SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: NOT list_contains({Q.SW_BASE}, x)) AS tokens FROM documents")
def tokenize_baseline(spark, d):
    return _docs(spark, d).select("doc_id", T.tokenize(F.col("text"), T.BASELINE).alias("tokens"))


@query("SELECT term, s AS stem FROM stems")
def stem_vocabulary(spark, d):
    """Every distinct word of documents and queries, and its stem."""
    cut = lambda rows, c: rows.select(F.explode(T.words(F.col(c))).alias("term"))
    words = cut(X.papers(spark, d), "text").union(cut(X.query_texts(spark, d), "query")).distinct()
    return words.select("term", stem.stem(F.col("term")).alias("stem"))


_NOSTEM = Q.index("pno", "papers_full", stemmed=False) | {"qtno": "SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM q) GROUP BY query_id, term"}


@query("SELECT query_id, doc_id, score, rank FROM (" + Q.bm25("pno", 100, *R.TUNED["paper"], terms="qtno") + ")", _NOSTEM)
def bm25_unstemmed(spark, d):
    rows = X.papers(spark, d).select("doc_id", T.tokenize(F.col("text"), T.UNSTEMMED).alias("tokens"))
    queries = X.query_texts(spark, d).select("query_id", T.tokenize(F.col("query"), T.UNSTEMMED).alias("tokens"))
    return longs(R.bm25(queries, I.build(C.non_empty(rows)), 100, *R.TUNED["paper"]))


_TEXT_FIELDS = rf"""SELECT doc_id, 2000 + CAST(substr(lpad(CAST(CAST(doc_id AS BIGINT) % 10000 AS VARCHAR), 4, '0'), 1, 2) AS BIGINT) AS year,
  CASE WHEN title <> '' THEN title || '. ' || text ELSE text END AS titled, trim(title || ' ' || source) AS headed,
  CAST(len(regexp_extract_all(text, '[^{Q.SP}]+')) AS BIGINT) AS n_words, regexp_replace(regexp_replace(text, '^[{Q.SP}]+|[{Q.SP}]+$', '', 'g'), '[{Q.SP}]+', ' ', 'g') AS normal FROM papers"""


@query(_TEXT_FIELDS)
def text_fields(spark, d):
    number = F.lpad((F.col("doc_id").cast("long") % 10000).cast("string"), 4, "0")
    return longs(X.papers(spark, d).select(
        "doc_id", T.paper_year(number).alias("year"), T.title_and_text(F.col("title"), F.col("text")).alias("titled"), T.title_and_abstract(F.col("title"), F.col("source")).alias("headed"),
        T.count_words(F.col("text")).alias("n_words"), T.normalize_space(F.col("text")).alias("normal"),
    ))


# --- collections, index, statistics ---


@query("SELECT doc_id, paper_id, pos, text, s.tokens FROM paras_full JOIN paras_s s USING (doc_id)")
def paragraph_collection(spark, d):
    return C.non_empty(X.paragraph_tokens(spark, d))


@query(f"SELECT doc_id, paper_id, title, cleaned AS text FROM (SELECT p.doc_id, paper_id, q.title, {_STEP3.replace('(t,', '(p.text,').replace('length(t)', 'length(p.text)').replace('ELSE t END', 'ELSE p.text END')} AS cleaned FROM paras p JOIN papers q ON p.paper_id = q.doc_id) WHERE cleaned <> ''")
def neural_collection(spark, d):
    return C.neural_collection(X.papers(spark, d), X.paragraphs(spark, d))


@query("SELECT doc_id, text FROM (SELECT doc_id, trim(title || ' ' || coalesce(abstract, '')) AS text FROM meta) WHERE text <> '' UNION ALL SELECT p.doc_id, CASE WHEN m.title <> '' THEN m.title || '. ' || p.text ELSE p.text END FROM paras p JOIN meta m ON m.doc_id = p.paper_id WHERE trim(p.text) <> ''")
def encoder_texts(spark, d):
    """Both collections' texts as encoders take them."""
    meta, parts = X.metadata(spark, d), X.paragraphs(spark, d)
    return C.texts(meta, parts, "paper").unionByName(C.texts(meta, parts, "paragraph", with_title=True))


@query("SELECT doc_id, paper_id, pos FROM paras WHERE len(tokens) = 0")
def empty_paragraphs(spark, d):
    return C.empty(X.paragraph_tokens(spark, d)).select("doc_id", "paper_id", "pos")


@query("SELECT * FROM meta")
def paper_metadata(spark, d):
    return X.metadata(spark, d)


_MANIFEST = "(SELECT count(*) AS {0}s_read, count(*) FILTER (WHERE len(tokens) > 0) AS {0}s, count(*) FILTER (WHERE len(tokens) = 0) AS empty_{0}s, CAST(sum(len(tokens)) AS BIGINT) AS {0}_tokens FROM {1})"


@query(f"SELECT * FROM {_MANIFEST.format('paper', 'papers')}, {_MANIFEST.format('paragraph', 'paras')}")
def collection_manifest(spark, d):
    return C.manifest(X.paper_tokens(spark, d), X.paragraph_tokens(spark, d))


@query("SELECT term, doc_id, tf FROM pap_p")
def inverted_index(spark, d):
    return X.paper_index(spark, d).postings.select("term", "doc_id", "tf")


@query(f"SELECT term, block, list(doc_id ORDER BY doc_id) AS docs, list(tf ORDER BY doc_id) AS tfs FROM (SELECT term, doc_id, tf, CAST('0x' || substr(md5(doc_id), 1, 7) AS BIGINT) % CAST(ceil(df / {I.BLOCK}.0) AS BIGINT) AS block FROM pap_p JOIN pap_t USING (term)) GROUP BY term, block")
def postings_lists(spark, d):
    ix = X.paper_index(spark, d)
    return I.postings_lists(ix.postings, ix.term_stats)


@query("SELECT term, doc_id, tf, doc_length FROM pap_p JOIN pap_d USING (doc_id)")
def packed_postings(spark, d):
    """What the tiles and blocks hold that BM25 ranks from."""
    return blocks.unpack(X.paper_index(spark, d).parts)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM papers_full")
def doc_numbers(spark, d):
    return X.paper_index(spark, d).doc_numbers()


@query("SELECT term, df, CAST(cf AS BIGINT) AS cf, round(idf, 6) AS idf FROM pap_t")
def term_stats(spark, d):
    return rounded(X.paper_index(spark, d).term_stats.drop("tidf"))


@query("SELECT num_docs, round(avg_doc_length, 6) AS avg_doc_length FROM pap_c")
def collection_stats(spark, d):
    return rounded(X.paper_index(spark, d).collection_stats)


_LEN = "SELECT doc_id, text, CAST(len(tokens) AS BIGINT) AS n, row_number() OVER (ORDER BY len(tokens), doc_id) AS r, count(*) OVER () AS total FROM {0}"


@query(
    "SELECT (SELECT count(*) FROM l) AS docs, min(n) AS min_tokens, max(n) AS max_tokens, count(*) FILTER (WHERE n = 0) AS empty, count(*) FILTER (WHERE n > 0 AND n < 10) AS short, count(*) FILTER (WHERE n > 1000) AS long, "
    "count(*) FILTER (WHERE (length(text) - length(replace(text, '$', ''))) % 2 = 1) AS odd_dollars, CAST(sum(n) AS BIGINT) AS total_tokens, CAST(median(n) AS DOUBLE) AS median_tokens, "
    "max(n) FILTER (WHERE r = least(total, CAST(floor(total * 0.9::DOUBLE) AS BIGINT) + 1)) AS p90_tokens, (SELECT count(*) FROM par_t) AS unique_tokens, (SELECT count(*) FROM par_t WHERE cf = 1) AS singletons FROM l",
    {"l": _LEN.format("paras")},
)
def corpus_stats(spark, d):
    return S.corpus_stats(_lengths(spark, d), X.paragraph_index(spark, d).term_stats)


@X._kept
def _lengths(spark, d):
    return S.lengths(X.paragraph_tokens(spark, d)).persist()


@query("SELECT doc_id, substr(text, 1, 100) AS preview FROM paras WHERE len(tokens) < 10 ORDER BY doc_id LIMIT 5")
def short_examples(spark, d):
    return S.short_examples(X.paragraph_tokens(spark, d))


_P = {"p10": 0.1, "p50": 0.5, "p90": 0.9, "p99": 0.99, "p100": 1.0}


@query("SELECT " + ", ".join(f"max(n) FILTER (WHERE r = least(total, CAST(floor(total * {p}::DOUBLE) AS BIGINT) + 1)) AS {k}" for k, p in _P.items()) + " FROM l", {"l": _LEN.format("papers")})
def length_percentiles(spark, d):
    return S.percentiles(X.paper_tokens(spark, d).select(F.size("tokens").cast("long").alias("n")), "n", _P)


@query("SELECT term, CAST(cf AS BIGINT) AS n FROM pap_t ORDER BY cf DESC, term LIMIT 50")
def top_tokens(spark, d):
    return S.top_tokens(X.paper_tokens(spark, d), 50)


@query("SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_tokens, substr(text, 1, 80) AS preview FROM paras ORDER BY len(tokens) DESC, doc_id DESC LIMIT 10")
def longest_paragraphs(spark, d):
    return S.longest(X.paragraph_tokens(spark, d), 10)


# --- lexical ranking ---

_RUN = "SELECT query_id, doc_id, score, rank FROM {}"


@query(_RUN.format("bm25"))
def bm25_papers(spark, d):
    return longs(X.bm25_run(spark, d))


@query(_RUN.format("bm25def"), {"bm25def": Q.bm25("pap", 100, *R.DEFAULT)})
def bm25_papers_default(spark, d):
    return longs(R.bm25(X.queries(spark, d), X.paper_index(spark, d), 100))


@query(f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY score DESC) AS r FROM ({Q.bm25_scores('pap', *R.TUNED['paper'])})) WHERE r <= 10")
def bm25_ties(spark, d):
    """The ten best and all that score like the tenth."""
    return longs(R.bm25(X.queries(spark, d), X.paper_index(spark, d), 10, *R.TUNED["paper"], ties=True))


@query(_RUN.format("bm25par") + " WHERE rank <= 100")
def bm25_paragraphs(spark, d):
    return longs(X.paragraph_run(spark, d).where("rank <= 100"))


@query(
    "SELECT query_id, doc_id, term, qtf, tf, round(idf, 6) AS idf, round(qtf * idf * tf * 5.0 / (tf + 4.0 * (0.25 + 0.75 * doc_length / avg_doc_length)), 6) AS part FROM qt JOIN pap_p USING (term) JOIN pap_t USING (term) JOIN pap_d USING (doc_id) JOIN (SELECT query_id, doc_id FROM bm25) USING (query_id, doc_id), pap_c"
)
def bm25_explain(spark, d):
    return rounded(R.bm25_explain(X.queries(spark, d), X.paper_index(spark, d), X.bm25_run(spark, d), *R.TUNED["paper"]))


@query("SELECT doc_id, round(norm, 6) AS norm FROM pap_n")
def tfidf_doc_norms(spark, d):
    return rounded(X.paper_index(spark, d).doc_norms)


@query(_RUN.format("pap_tfidf"))
def tfidf_papers(spark, d):
    return longs(X.tfidf_run(spark, d))


@query(_RUN.format("par_tfidf"))
def tfidf_paragraphs(spark, d):
    return longs(X.paragraph_tfidf_run(spark, d))


@query("SELECT query_id, rank, query_id || chr(9) || 'Q0' || chr(9) || doc_id || chr(9) || CAST(rank AS VARCHAR) || chr(9) || printf('%.6f', score) || chr(9) || 'bm25' AS line FROM bm25")
def run_file(spark, d):
    return longs(writers.run_lines(X.bm25_run(spark, d), "bm25"))


@query("SELECT query_id, count(*) AS n, count(*) <= 100 AND min(rank) = 1 AND max(rank) = count(*) AS valid FROM bm25 GROUP BY query_id")
def run_validation(spark, d):
    run = X.bm25_run(spark, d)
    bad = writers.unsorted(run).select("query_id").distinct().withColumn("bad", F.lit(True))
    n = run.groupBy("query_id").agg(F.count("*").alias("n"), F.min("rank").alias("a"), F.max("rank").alias("b"))
    return n.join(bad, "query_id", "left").select("query_id", "n", ((F.col("n") <= 100) & (F.col("a") == 1) & (F.col("b") == F.col("n")) & F.col("bad").isNull()).alias("valid"))


@query("SELECT count(*) AS queries, count(*) FILTER (WHERE n = 0) AS without_results, count(*) FILTER (WHERE n > 0 AND n < 100) AS with_few, round(avg(n), 6) AS mean_results FROM (SELECT q.query_id, count(r.doc_id) AS n FROM q LEFT JOIN bm25 r USING (query_id) GROUP BY q.query_id)")
def run_shape(spark, d):
    return rounded(S.run_shape(X.queries(spark, d).select("query_id"), X.bm25_run(spark, d)))


# --- vectors, fusion ---


@query(_RUN.format("sparse"))
def sparse_topk(spark, d):
    return longs(X.sparse_run(spark, d))


@query(_RUN.format("dense"))
def dense_topk(spark, d):
    return longs(R.dense(X.vector_queries(spark, d), X.vector_chunks(spark, d), 100))


@query("SELECT doc_id, i AS dim, round(CAST(vector[i] AS DOUBLE) / sqrt(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS x FROM vec, (SELECT unnest(range(1, 65)) AS i)")
def l2_normalize(spark, d):
    rows = X.vectors(spark, d).select("doc_id", F.posexplode(R.l2_normalize(F.col("vector"))).alias("p", "x"))
    return rounded(rows.select("doc_id", (F.col("p") + 1).cast("long").alias("dim"), "x"))


@query("SELECT CAST(label AS VARCHAR) AS doc_id, i AS term, round(max(ln(1 + greatest(CAST(vector[i] AS DOUBLE), 0))), 6) AS weight FROM vec, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i HAVING max(vector[i]) > 0")
def splade_max_pool(spark, d):
    rows = X.vectors(spark, d).select(F.col("label").cast("string").alias("doc_id"), F.posexplode("vector").alias("p", "x"))
    return rounded(R.max_pool(rows.select("doc_id", (F.col("p") + 1).cast("long").alias("term"), F.col("x").cast("double").alias("x"), F.lit(1).alias("mask"))))


@query("SELECT round(sum(power(s / n, 2)), 6) AS flops FROM (SELECT term, sum(weight) AS s FROM sw GROUP BY term), (SELECT count(DISTINCT doc_id) AS n FROM sw)")
def flops_regularizer(spark, d):
    return rounded(R.flops(X.sparse_weights(X.paper_index(spark, d))))


_UNIT = "SELECT vec_id, vec_id // 64 AS batch, list_transform(embedding, lambda x: CAST(x AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda y: CAST(y AS DOUBLE) * CAST(y AS DOUBLE))))) AS v FROM embeddings"
_MNR = {
    "uv": _UNIT,
    "mp": "SELECT a.batch, a.vec_id AS pair, a.v AS a, b.v AS p FROM uv a JOIN uv b ON b.vec_id = a.vec_id + 1",
    "ms": "SELECT x.batch, x.pair, y.pair AS other, 20 * list_sum(list_transform(range(1, 65), lambda i: x.a[i] * y.p[i])) AS s FROM mp x JOIN mp y USING (batch)",
}


@query("SELECT batch, round(avg(l), 6) AS loss FROM (SELECT batch, pair, ln(sum(exp(s))) - max(s) FILTER (WHERE pair = other) AS l FROM ms GROUP BY batch, pair) GROUP BY batch", _MNR)
def mnr_loss(spark, d):
    v = X.table(spark, d, "embeddings").select("vec_id", "embedding", F.floor(F.col("vec_id") / 64).alias("batch"))
    pairs = v.alias("a").join(v.alias("b"), F.col("b.vec_id") == F.col("a.vec_id") + 1).select(F.col("a.batch").alias("batch"), F.col("a.vec_id").alias("pair"), F.col("a.embedding").alias("a"), F.col("b.embedding").alias("p"))
    return rounded(R.mnr_loss(pairs))


@query("SELECT count(*) AS vectors, CAST(sum(n) AS BIGINT) AS nonzero, round(avg(n), 6) AS mean_active, max(n) AS most_active FROM (SELECT doc_id, count(*) AS n FROM sw GROUP BY doc_id)")
def sparse_index_stats(spark, d):
    n = X.sparse_weights(X.paper_index(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n"))
    return rounded(n.agg(F.count("*").alias("vectors"), F.sum("n").alias("nonzero"), F.avg("n").alias("mean_active"), F.max("n").alias("most_active")))


_MAXP = Q.ranked("SELECT query_id, regexp_replace(doc_id, '_[^_]*$', '') AS doc_id, max(score) AS score FROM bm25par GROUP BY query_id, regexp_replace(doc_id, '_[^_]*$', '')", 100)


@query(_RUN.format(f"({_MAXP})"))
def bm25_maxp(spark, d):
    return longs(R.maxp(X.paragraph_run(spark, d)))


@query(_RUN.format(f"({_MAXP})"))
def maxp_by_table(spark, d):
    """The papers of the paragraphs are looked up, and must be known."""
    return longs(R.maxp(X.paragraph_run(spark, d), X.paragraphs(spark, d).select("doc_id", "paper_id")))


@query("SELECT query_id, doc_id AS paragraph_id, regexp_replace(doc_id, '_[^_]*$', '') AS paper_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, regexp_replace(doc_id, '_[^_]*$', '') ORDER BY rank) AS n FROM bm25par) WHERE n = 1")
def maxp(spark, d):
    w = Window.partitionBy("query_id", "paper_id").orderBy("rank")
    run = X.paragraph_run(spark, d).withColumn("paper_id", F.regexp_replace("doc_id", "_[^_]*$", "")).withColumn("n", F.row_number().over(w))
    return run.where("n = 1").select("query_id", F.col("doc_id").alias("paragraph_id"), "paper_id", "score")


@query(_RUN.format("(" + Q.ranked("SELECT query_id, CAST(CAST(doc_id AS BIGINT) // 10 AS VARCHAR) AS doc_id, max(score) AS score FROM (" + Q.ranked("SELECT * FROM densefull", 2000) + ") GROUP BY query_id, CAST(doc_id AS BIGINT) // 10", 100) + ")"))
def dense_maxp(spark, d):
    v = X.vectors(spark, d)
    group = v.select("doc_id", F.floor(F.col("doc_id").cast("long") / 10).cast("string").alias("paper_id"))
    return longs(R.maxp(X.stored(R.dense(X.vector_queries(spark, d), X.vector_chunks(spark, d), 2000)), group))


@query(_RUN.format("rrfpap"))
def rrf_two(spark, d):
    return longs(R.rrf([X.bm25_run(spark, d), X.tfidf_run(spark, d)]))


@query(_RUN.format(f"({Q.rrf('bm25', 'sparse', 'pap_tfidf')})"))
def rrf_three(spark, d):
    return longs(R.rrf([X.bm25_run(spark, d), X.sparse_run(spark, d), X.tfidf_run(spark, d)]))


@query("SELECT 'bm25' AS model, query_id, doc_id, score, rank FROM bm25 UNION ALL SELECT 'tfidf', query_id, doc_id, score, rank FROM pap_tfidf UNION ALL SELECT 'sparse', query_id, doc_id, score, rank FROM sparse UNION ALL SELECT 'dense', query_id, doc_id, score, rank FROM dense")
def rankers(spark, d):
    """Every ranker behind the common surface: texts in, runs out."""
    texts, ix = X.query_texts(spark, d), X.paper_index(spark, d)
    weigh = lambda q: R.query_terms(q.select("query_id", T.tokenize(F.col("query")).alias("tokens"))).select("query_id", "term", F.log1p("qtf").alias("weight"))
    each = {"bm25": R.Bm25(ix, *R.TUNED["paper"]), "tfidf": R.TfIdf(ix), "sparse": R.Sparse(X.sparse_weights(ix), weigh)}
    out = R.dense(X.vector_queries(spark, d), X.vector_chunks(spark, d), 100).select(F.lit("dense").alias("model"), "query_id", "doc_id", "score", "rank")
    for name, ranker in each.items():
        out = out.unionByName(ranker.rank(texts).select(F.lit(name).alias("model"), "query_id", "doc_id", "score", "rank"))
    return longs(out)


_ENCODED = {
    "ev": f"SELECT query_id, CAST('0x' || substr(md5(w), 1, 7) AS BIGINT) % 64 + 1 AS i, sum(CASE WHEN CAST('0x' || substr(md5(w), 8, 1) AS BIGINT) % 2 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) AS v FROM (SELECT query_id, unnest(regexp_extract_all(lower(query), '[^{Q.SP}]+')) AS w FROM q) GROUP BY query_id, i",
    "ef": "SELECT query_id, i, CAST(CAST(v / sqrt(sum(v * v) OVER (PARTITION BY query_id)) AS FLOAT) AS DOUBLE) AS x FROM ev",
    "en": "SELECT query_id, i, x / sqrt(sum(x * x) OVER (PARTITION BY query_id)) AS x FROM ef",
}


@query(_RUN.format("(" + Q.ranked("SELECT query_id, doc_id, round(sum(x * CAST(vector[i] AS DOUBLE)), 6) AS score FROM en, vec GROUP BY query_id, doc_id", 100) + ")"), _ENCODED)
def dense_ranker(spark, d):
    """Query texts, encoded, against the given vectors, by the common surface."""
    return longs(R.Dense(X.vector_chunks(spark, d), encoders.HashEncoder).rank(X.query_texts(spark, d)))


# --- evaluation ---


def _metrics(spark, d):
    return M.per_query(X.bm25_run(spark, d), X.qrels(spark, d))


def _metric(name: str, *cols: str) -> None:
    """A query with some of the metrics of the BM25 run, per judged query."""
    picked = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    query(f"SELECT query_id, {picked} FROM m", Q.metric_steps("bm25"), name)(lambda spark, d: rounded(_metrics(spark, d).select("query_id", *cols)))


for _name, *_cols in (
    ("ndcg", "ndcg"), ("ndcg_at_5", "ndcg_at_5"), ("ndcg_at_10", "ndcg_at_10"), ("ndcg_exponential", "ndcg_exp", "ndcg_exp_at_5"), ("mrr", "mrr"), ("mrr_at_10", "mrr_at_10"),
    ("precision_at_k", "p_at_5", "p_at_10"), ("recall_at_100", "recall_at_100"), ("recall_at_k", "recall_at_5", "recall_at_10"), ("accuracy_at_k", "accuracy_at_1", "accuracy_at_5", "accuracy_at_10"),
):
    _metric(_name, *_cols)

_LOCAL = {
    "lr": "SELECT r.query_id, r.doc_id, r.rank, power(2, coalesce(j.grade, 0)) - 1 AS g FROM bm25 r LEFT JOIN qrels j ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE r.query_id IN (SELECT query_id FROM qrels)",
    "lb": "SELECT query_id, sum(g / log2(n + 1)) AS b FROM (SELECT query_id, g, row_number() OVER (PARTITION BY query_id ORDER BY g DESC, rank) AS n FROM lr) GROUP BY query_id",
}


@query("SELECT query_id, round(CASE WHEN b > 0 THEN a / b ELSE 0 END, 6) AS ndcg FROM (SELECT query_id, sum(g / log2(rank + 1)) AS a FROM lr GROUP BY query_id) JOIN lb USING (query_id)", _LOCAL)
def ndcg_list_local(spark, d):
    return rounded(M.ndcg_list_local(X.bm25_run(spark, d), X.qrels(spark, d)))


_STRICT = {"strict_q": "SELECT * FROM qrels WHERE grade = 2"} | Q.metric_steps("bm25", "strict_q")


@query("SELECT query_id, round(mrr, 6) AS mrr, round(p_at_5, 6) AS p_at_5 FROM m", _STRICT)
def strict_metrics(spark, d):
    return rounded(M.per_query(X.bm25_run(spark, d), M.strict(X.qrels(spark, d))).select("query_id", "mrr", "p_at_5"))


@query("SELECT q.query_id, round(coalesce(m.ndcg, 0), 6) AS ndcg FROM (SELECT DISTINCT query_id FROM qrels) q LEFT JOIN m USING (query_id)", Q.metric_steps("bm25"))
def make_comparable(spark, d):
    known = X.qrels(spark, d).select("query_id").distinct()
    return rounded(known.join(_metrics(spark, d).select("query_id", "ndcg"), "query_id", "left").fillna(0.0))


@X._kept
def _by_model(spark, d):
    return M.by_model(X.runs(spark, d, "paper"), X.qrels(spark, d), X.MODELS["paper"]).persist()


_MODELS = Q.metric_steps("runs", by="model")
_PAIRS = "SELECT a.query_id, a.model AS model_a, b.model AS model_b, a.ndcg - b.ndcg AS d FROM m a JOIN m b ON a.query_id = b.query_id AND a.model < b.model"


@query(f"SELECT query_id, model_a, model_b, round(d, 6) AS d FROM ({_PAIRS})", _MODELS)
def paired_differences(spark, d):
    return rounded(M.paired_differences(_by_model(spark, d), "ndcg"))


_T = f"SELECT model_a, model_b, count(*) AS n, avg(d) AS mean_d, CASE WHEN stddev_samp(d) > 0 THEN avg(d) / (stddev_samp(d) / sqrt(count(*))) END AS t FROM ({_PAIRS}) GROUP BY model_a, model_b"


@query(f"SELECT model_a, model_b, n, round(mean_d, 6) AS mean_d, round(t, 4) AS t FROM ({_T})", _MODELS)
def paired_t_statistic(spark, d):
    return rounded(rounded(M.paired_t(_by_model(spark, d), "ndcg")).withColumn("t", F.round("t", 4)))


# Student's distribution has a finite series in the angle for whole degrees of freedom v; products of its ratios by sums of logarithms
_TAIL = "list_sum(list_transform(range(0, {last}), lambda j: coalesce(exp(list_sum(list_transform(range(1, j + 1), lambda i: ln({ratio})))), 1) * power(cos(a), {power})))"
_ODD = _TAIL.format(last="(v - 1) // 2", ratio="2.0 * i / (2 * i + 1)", power="2 * j + 1")
_EVEN = _TAIL.format(last="v // 2", ratio="(2.0 * i - 1) / (2 * i)", power="2 * j")
_P_VALUE = f"CASE WHEN t IS NULL OR n < 2 THEN 1.0 WHEN v % 2 = 1 THEN greatest(0, 1 - 2 / pi() * (a + sin(a) * coalesce({_ODD}, 0))) ELSE greatest(0, 1 - sin(a) * coalesce({_EVEN}, 0)) END"


@query(f"SELECT model_a, model_b, n, round(mean_d, 6) AS mean_d, round(t, 4) AS t, round(p, 6) AS p, p < 0.05 AS significant FROM (SELECT *, {_P_VALUE} AS p FROM (SELECT *, n - 1 AS v, atan(abs(t) / sqrt(n - 1)) AS a FROM tt))", _MODELS | {"tt": _T})
def significance(spark, d):
    return rounded(M.significance(_by_model(spark, d), "ndcg").withColumn("t", F.round("t", 4)))


_FISHER = {
    "pd": _PAIRS,
    "fo": "SELECT model_a, model_b, count(*) AS n, round(avg(d), 9) AS mean_d FROM pd GROUP BY model_a, model_b",
    "fd": f"SELECT model_a, model_b, draw, round(avg(CASE WHEN CAST('0x' || substr(md5('42-' || CAST(draw AS VARCHAR) || '-' || query_id), 1, 4) AS BIGINT) % 2 = 1 THEN -d ELSE d END), 9) AS m FROM pd, (SELECT unnest(range(1, {M.DRAWS + 1})) AS draw) GROUP BY model_a, model_b, draw",
}


@query(f"SELECT model_a, model_b, n, round(mean_d, 6) AS mean_d, round((count(*) FILTER (WHERE abs(m) >= abs(mean_d)) + 1) / {M.DRAWS + 1}.0, 6) AS p FROM fd JOIN fo USING (model_a, model_b) GROUP BY model_a, model_b, n, mean_d", _MODELS | _FISHER)
def significance_fisher(spark, d):
    return rounded(M.randomization(_by_model(spark, d), "ndcg"))


_TUKEY = {
    "tm": "SELECT model, round(avg(ndcg), 9) AS mean FROM m GROUP BY model",
    "td": f"SELECT draw, seat, round(avg(ndcg), 9) AS x FROM (SELECT draw, ndcg, row_number() OVER (PARTITION BY draw, query_id ORDER BY md5('42-' || CAST(draw AS VARCHAR) || '-' || query_id || '-' || model), model) AS seat FROM m, (SELECT unnest(range(1, {M.DRAWS + 1})) AS draw)) GROUP BY draw, seat",
    "tr": "SELECT draw, round(max(x) - min(x), 9) AS spread FROM td GROUP BY draw",
    "tp": "SELECT a.model AS model_a, b.model AS model_b, round(a.mean - b.mean, 9) AS mean_d FROM tm a JOIN tm b ON a.model < b.model",
}


@query(f"SELECT model_a, model_b, round(mean_d, 6) AS mean_d, round((count(*) FILTER (WHERE spread >= abs(mean_d)) + 1) / {M.DRAWS + 1}.0, 6) AS p FROM tp, tr GROUP BY model_a, model_b, mean_d", _MODELS | _TUKEY)
def significance_tukey(spark, d):
    return rounded(M.tukey(_by_model(spark, d), "ndcg"))


def _report_sql(collection: str, runs: str, qrels: str) -> tuple[str, dict[str, str]]:
    """Rows of the report of a collection, and its steps, under names of their own."""
    body, steps = [], {}
    for setting, judged, wanted in (("graded", qrels, M.GRADED), ("strict", f"(SELECT * FROM {qrels} WHERE grade = 2)", M.STRICT)):
        tag = f"{collection[:4]}{setting[0]}"
        steps |= {f"{tag}_j": f"SELECT * FROM {judged}"}
        for k, v in Q.metric_steps(runs, f"{tag}_j", by="model").items():
            for other in ("rows_", "found", "best", "rel"):
                v = re.sub(rf"\b(FROM|JOIN) {other}\b", rf"\1 {tag}_{other}", v)
            steps[f"{tag}_{k}"] = v
        for metric in wanted:
            body.append(f"SELECT '{collection}' AS collection, '{setting}' AS setting, model, '{metric}' AS metric, round(avg({metric}), 6) AS value FROM {tag}_m GROUP BY model")
    return " UNION ALL ".join(body), steps


_PAPER_REPORT, _PARA_REPORT = _report_sql("paper", "runs", "qrels"), _report_sql("paragraph", "pruns", "pqrels")
_SHOWN = "CASE model WHEN 'bm25' THEN 'BM25' WHEN 'sparse' THEN 'SPLADE' WHEN 'tfidf' THEN 'TF-IDF' WHEN 'rrf:bm25+tfidf' THEN 'RRF(BM25+TF-IDF)' END"


@query(f"SELECT collection, setting, {_SHOWN} AS name, metric, value FROM ({_PAPER_REPORT[0]} UNION ALL {_PARA_REPORT[0]})", _PAPER_REPORT[1] | _PARA_REPORT[1])
def evaluation_report(spark, d):
    """Both collections, graded and strict, in one pass."""
    both = lambda get: get("paper").withColumn("collection", F.lit("paper")).unionByName(get("paragraph").withColumn("collection", F.lit("paragraph")))
    qrels = both(lambda c: (X.qrels if c == "paper" else X.paragraph_qrels)(spark, d))
    rows = M.report(both(lambda c: X.runs(spark, d, c)), qrels, X.MODELS)
    return rounded(rows.select("collection", "setting", M.display_names(F.col("model")).alias("name"), "metric", "value"))


@query("SELECT label, count(*) AS n, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM m JOIN q USING (query_id) GROUP BY label", Q.metric_steps("bm25"))
def metrics_by_label(spark, d):
    rows = _metrics(spark, d).join(X.query_texts(spark, d).select("query_id", "label"), "query_id")
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.avg("ndcg").alias("ndcg"), F.avg("mrr").alias("mrr")))


@query("SELECT label, CAST(grade AS BIGINT) AS grade, count(*) AS n FROM qrels JOIN q USING (query_id) GROUP BY label, grade")
def annotation_summary(spark, d):
    return longs(X.qrels(spark, d).join(X.query_texts(spark, d).select("query_id", "label"), "query_id").groupBy("label", "grade").agg(F.count("*").alias("n")))


@query("SELECT query_id, label FROM q WHERE query_id IN (SELECT query_id FROM qrels)")
def judged_queries(spark, d):
    return X.queries(spark, d).join(X.qrels(spark, d), "query_id", "left_semi").select("query_id", "label")


# --- tuning and training data ---

_CELLS = "SELECT CAST(k1 AS DOUBLE) AS k1, CAST(b AS DOUBLE) AS b FROM (SELECT unnest([0.6, 0.9, 1.2, 1.5, 1.8]) AS k1), (SELECT unnest([0.2, 0.4, 0.6, 0.75, 0.9]) AS b)"


def _grid_steps(cells: str, judged: str) -> dict[str, str]:
    """Step gq: nDCG@5 of each cell and query of `judged`."""
    return {
        "cells": cells,
        "jq": judged,
        "gs": "SELECT k1, b, query_id, doc_id, round(sum(qtf * idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * doc_length / avg_doc_length))), 6) AS score FROM qt JOIN jq USING (query_id) JOIN pap_p USING (term) JOIN pap_t USING (term) JOIN pap_d USING (doc_id), pap_c, cells GROUP BY k1, b, query_id, doc_id",
        "gr": "SELECT *, row_number() OVER (PARTITION BY k1, b, query_id ORDER BY score DESC, doc_id) AS rank FROM gs",
        "gd": "SELECT k1, b, query_id, sum(grade / log2(rank + 1)) AS dcg FROM gr JOIN qrels USING (query_id, doc_id) WHERE rank <= 5 GROUP BY k1, b, query_id",
        "gi": "SELECT query_id, sum(grade / log2(n + 1)) AS best FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS n FROM qrels) WHERE n <= 5 GROUP BY query_id",
        "gq": "SELECT k1, b, query_id, coalesce(dcg / best, 0) AS ndcg_at_5 FROM (SELECT * FROM jq, cells) LEFT JOIN gd USING (k1, b, query_id) LEFT JOIN gi USING (query_id)",
        "gm": "SELECT k1, b, round(avg(ndcg_at_5), 6) AS ndcg_at_5 FROM gq GROUP BY k1, b",
    }


_SAMPLE = "SELECT query_id, pos <= floor(count(*) OVER () * 0.2::DOUBLE) AS held_out FROM (SELECT query_id, row_number() OVER (ORDER BY md5('42-' || query_id), query_id) AS pos FROM (SELECT DISTINCT query_id FROM qrels)) WHERE pos <= 400"
_GRID = {"ho": _SAMPLE} | _grid_steps(_CELLS, "SELECT query_id FROM ho WHERE NOT held_out")


@X._kept
def _tuning_split(spark, d):
    return U.tuning_sample(X.qrels(spark, d)).persist()


@X._kept
def _grid(spark, d):
    """Of the tuning queries alone."""
    queries = X.queries(spark, d).join(_tuning_split(spark, d).where("not held_out"), "query_id", "left_semi")
    return X.stored(U.grid_means(U.bm25_grid(queries, X.paper_index(spark, d), X.qrels(spark, d))))


@query("SELECT query_id, held_out FROM ho", _GRID)
def tuning_sample(spark, d):
    return _tuning_split(spark, d)


@query("SELECT * FROM gm", _GRID)
def bm25_grid(spark, d):
    return _grid(spark, d)


@query("SELECT * FROM gm ORDER BY ndcg_at_5 DESC, k1, b LIMIT 1", _GRID)
def bm25_best_params(spark, d):
    return U.best_cell(_grid(spark, d))


_HELD = {"best_cell": "SELECT 'best' AS setting, k1, b FROM (SELECT * FROM gm ORDER BY ndcg_at_5 DESC, k1, b LIMIT 1) UNION ALL SELECT 'default', 0.9::DOUBLE, 0.4::DOUBLE UNION ALL SELECT 'textbook', 1.2::DOUBLE, 0.75::DOUBLE"}
_HELD |= {"h_" + k: re.sub(r"\b(cells|jq|gs|gr|gd|gi)\b", r"h_\1", v) for k, v in _grid_steps("SELECT DISTINCT k1, b FROM best_cell", "SELECT query_id FROM ho WHERE held_out").items() if k != "gm"}


@query("SELECT setting, k1, b, count(*) AS n, round(avg(ndcg_at_5), 6) AS ndcg_at_5 FROM h_gq JOIN best_cell USING (k1, b) GROUP BY setting, k1, b", _GRID | _HELD)
def bm25_heldout(spark, d):
    """The chosen cell and the known settings on queries that chose nothing."""
    return U.held_out_check(X.queries(spark, d), X.paper_index(spark, d), X.qrels(spark, d), _tuning_split(spark, d), _grid(spark, d))


@query("SELECT k1, max(ndcg_at_5) FILTER (WHERE b = 0.2) AS \"0.2\", max(ndcg_at_5) FILTER (WHERE b = 0.4) AS \"0.4\", max(ndcg_at_5) FILTER (WHERE b = 0.6) AS \"0.6\", max(ndcg_at_5) FILTER (WHERE b = 0.75) AS \"0.75\", max(ndcg_at_5) FILTER (WHERE b = 0.9) AS \"0.9\" FROM gm GROUP BY k1", _GRID)
def tuning_grid_pivot(spark, d):
    return readers.grid_matrix(_grid(spark, d), "ndcg_at_5")


@query("SELECT query_id, doc_id, rank FROM bm25 WHERE rank <= 50")
def run_candidates(spark, d):
    return longs(U.candidates(X.bm25_run(spark, d), 50))


_HARD = {
    "hc": "SELECT query_id, doc_id, rank FROM bm25 b WHERE rank > 20 AND NOT EXISTS (SELECT 1 FROM qrels j WHERE j.query_id = b.query_id AND j.doc_id = b.doc_id)",
    "hn": "SELECT query_id, doc_id, pick FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY md5('42-' || query_id || '-' || doc_id), doc_id) AS pick FROM hc) WHERE pick <= 30",
    "ex": "SELECT q.query_id, query, label, pos, coalesce(neg, []) AS neg FROM q JOIN (SELECT query_id, list(doc_id ORDER BY doc_id) AS pos FROM qrels GROUP BY query_id) USING (query_id) LEFT JOIN (SELECT query_id, list(doc_id ORDER BY pick) AS neg FROM hn GROUP BY query_id) USING (query_id)",
}


@query("SELECT query_id, doc_id, rank FROM hc", _HARD)
def hard_negative_candidates(spark, d):
    return longs(X.bm25_run(spark, d).where("rank > 20").join(X.qrels(spark, d), ["query_id", "doc_id"], "left_anti").select("query_id", "doc_id", "rank"))


@query("SELECT query_id, doc_id, pick FROM hn", _HARD)
def hard_negatives(spark, d):
    return longs(U.hard_negatives(X.bm25_run(spark, d), X.qrels(spark, d)))


def _examples(spark, d):
    return U.training_examples(X.query_texts(spark, d), X.qrels(spark, d), X.bm25_run(spark, d), collection=X.paper_index(spark, d).doc_stats)


@query("SELECT query_id, query, label, list_aggregate(pos, 'string_agg', ',') AS positives, coalesce(list_aggregate(neg, 'string_agg', ','), '') AS negatives FROM ex", _HARD)
def training_examples(spark, d):
    ex = U.at_least(_examples(spark, d))
    return ex.select("query_id", "query", "label", F.array_join(F.array_sort(F.map_keys("positives")), ",").alias("positives"), F.array_join("negatives", ",").alias("negatives"))


@query("SELECT query_id, query AS anchor, p.text AS positive, n.text AS negative FROM (SELECT query_id, query, pos[i] AS pos_id, neg[(i - 1) % len(neg) + 1] AS neg_id FROM (SELECT *, unnest(range(1, len(pos) + 1)) AS i FROM ex WHERE len(neg) > 0)) JOIN papers p ON p.doc_id = pos_id JOIN papers n ON n.doc_id = neg_id", _HARD)
def training_triples(spark, d):
    return U.triples_of(X.query_texts(spark, d), X.qrels(spark, d), X.bm25_run(spark, d), X.papers(spark, d), collection=X.paper_index(spark, d).doc_stats)


@query("SELECT j.query_id, j.doc_id, q.query, p.text FROM qrels j JOIN q USING (query_id) JOIN papers p ON p.doc_id = j.doc_id WHERE grade > 0")
def training_pairs(spark, d):
    return U.training_pairs(X.query_texts(spark, d), X.qrels(spark, d), X.papers(spark, d))


_SPLIT = "SELECT query_id, label, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY md5('42-' || query_id), query_id) <= round_even(count(*) OVER (PARTITION BY label) * 0.1::DOUBLE, 0) THEN 'val' ELSE 'train' END AS split FROM q"


@query(_SPLIT)
def stratified_split(spark, d):
    return U.stratified_split(X.query_texts(spark, d).select("query_id", "label"))


@query("SELECT query_id, CASE WHEN row_number() OVER (ORDER BY md5('42-' || query_id), query_id) <= floor(count(*) OVER () * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM q")
def query_split(spark, d):
    kept = U.held_out(X.query_texts(spark, d), 0.8)
    return kept.select("query_id", F.when(F.col("held_out"), "train").otherwise("val").alias("split"))


@query("SELECT s.split, s.label, count(*) AS queries, CAST(sum(len(pos)) AS BIGINT) AS positives, CAST(sum(len(neg)) AS BIGINT) AS negatives FROM (" + _SPLIT + ") s JOIN ex USING (query_id) GROUP BY s.split, s.label", _HARD)
def training_manifest(spark, d):
    queries = X.query_texts(spark, d)
    return U.manifest_of(queries, U.stratified_split(queries.select("query_id", "label")), X.qrels(spark, d), X.bm25_run(spark, d), collection=X.paper_index(spark, d).doc_stats)


@query(
    "SELECT * FROM vj UNION ALL SELECT * FROM vc UNION ALL SELECT * FROM (SELECT doc_id, 'distractor' AS part FROM papers WHERE doc_id NOT IN (SELECT doc_id FROM vj) AND doc_id NOT IN (SELECT doc_id FROM vc) ORDER BY md5('42-' || doc_id), doc_id LIMIT 10000)",
    {"vj": "SELECT DISTINCT doc_id, 'judged' AS part FROM qrels", "vc": "SELECT DISTINCT doc_id, 'candidate' AS part FROM bm25 WHERE rank <= 100 AND doc_id NOT IN (SELECT doc_id FROM vj)"},
)
def validation_corpus(spark, d):
    return U.validation_corpus(X.papers(spark, d), X.qrels(spark, d), X.bm25_run(spark, d))


@query("SELECT query_id, list(doc_id ORDER BY doc_id) AS relevant FROM qrels WHERE grade > 0 AND doc_id IN (SELECT doc_id FROM papers_full) GROUP BY query_id")
def relevant_sets(spark, d):
    return U.relevant_sets(X.qrels(spark, d), X.paper_index(spark, d).doc_stats)


_EVAL = ("accuracy_at_1", "accuracy_at_5", "accuracy_at_10", "p_at_5", "p_at_10", "recall_at_5", "recall_at_10", "mrr_at_10", "ndcg_at_5", "ndcg_at_10")


@query("SELECT " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _EVAL) + " FROM m", Q.metric_steps("bm25"))
def validation_report(spark, d):
    """What the evaluator of training runs reports of a run over the validation corpus."""
    corpus = U.validation_corpus(X.papers(spark, d), X.qrels(spark, d), X.bm25_run(spark, d))
    run = X.bm25_run(spark, d).join(corpus.select("doc_id"), "doc_id", "left_semi")
    return rounded(M.means(M.per_query(run, X.qrels(spark, d)).select(*_EVAL)))


@query("SELECT 'paper_' || doc_id AS doc_id, text FROM papers UNION ALL SELECT 'paragraph_' || doc_id, text FROM paras")
def namespaced_corpus(spark, d):
    return U.namespaced(X.papers(spark, d), X.paragraphs(spark, d))


@query("SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM qrels) THEN title ELSE text END AS text FROM papers")
def overridden_corpus(spark, d):
    own = X.papers(spark, d).join(X.qrels(spark, d).select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", F.col("title").alias("text"))
    return U.overridden(X.papers(spark, d), own)


@query("SELECT j.query_id, j.doc_id, q.query, p.text FROM qrels j JOIN q USING (query_id) JOIN papers p ON p.doc_id = j.doc_id WHERE grade > 0 UNION ALL SELECT j.query_id, j.doc_id, q.query, p.text FROM pqrels j JOIN q USING (query_id) JOIN paras p ON p.doc_id = j.doc_id WHERE grade > 0")
def combined_pairs(spark, d):
    """Training pairs of papers and of paragraphs."""
    q = X.query_texts(spark, d)
    return U.training_pairs(q, X.qrels(spark, d), X.papers(spark, d)).unionByName(U.training_pairs(q, X.paragraph_qrels(spark, d), X.paragraphs(spark, d)))


def _log(spark, d):
    return X.table(spark, d, "events").groupBy((F.floor(F.col("event_id") / 50) * 50).alias("step")).agg(F.round(F.avg("value"), 9).alias("value"))


_LOG = {
    "lg": "SELECT event_id // 50 * 50 AS step, round(avg(value), 9) AS value FROM events GROUP BY 1",
    "lb": "SELECT *, coalesce(value > max(value) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS better FROM lg",
    "lr": "SELECT *, sum(CAST(better AS INT)) OVER (ORDER BY step) AS run FROM lb",
    "lw": "SELECT *, row_number() OVER (PARTITION BY run ORDER BY step) - 1 AS worse FROM lr",
    "ls": "SELECT min(step) FILTER (WHERE worse >= 3) AS stopped_at FROM lw",
}


@query("SELECT step, value, stopped_at FROM lg, ls WHERE stopped_at IS NULL OR step <= stopped_at ORDER BY value DESC, step LIMIT 1", _LOG)
def best_checkpoint(spark, d):
    return U.best_checkpoint(_log(spark, d))


@query("SELECT 0 AS step, -1.0::DOUBLE AS value UNION ALL SELECT step, value FROM lg", _LOG)
def training_curve(spark, d):
    return U.curve(_log(spark, d), -1.0)


# --- serving ---


@query("SELECT query_id, b.rank, b.doc_id, b.score, count(*) OVER (PARTITION BY query_id) AS total, title FROM bm25 b JOIN papers USING (doc_id) QUALIFY b.rank BETWEEN 11 AND 20")
def search_results_page(spark, d):
    return longs(V.results_page(X.bm25_run(spark, d), X.papers(spark, d), X.query_texts(spark, d), 2, 10).drop("excerpt"))


_EXCERPT = {
    "es": r"SELECT query_id, doc_id, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM (SELECT query_id, b.doc_id, str_split(regexp_replace(p.text, '([.!?])[\s\x0b]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM bm25 b JOIN papers p ON p.doc_id = b.doc_id)",
    "ew": "SELECT DISTINCT query_id, doc_id, i, stems.s AS term FROM (SELECT query_id, doc_id, i, unnest(" + Q.tok("s") + ") AS term FROM es) JOIN stems USING (term)",
    "eo": "SELECT query_id, doc_id, i, count(*) AS n FROM ew JOIN qt USING (query_id, term) GROUP BY query_id, doc_id, i",
    "eb": "SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY coalesce(n, 0) DESC, i) AS n FROM es LEFT JOIN eo USING (query_id, doc_id, i)",
}


@query("SELECT query_id, doc_id, CASE WHEN length(s) <= 300 THEN s ELSE regexp_replace(substr(s, 1, 300), ' [^ ]*$', '') || '...' END AS excerpt FROM eb WHERE n = 1", _EXCERPT)
def excerpt(spark, d):
    rows = X.bm25_run(spark, d).join(X.papers(spark, d).select("doc_id", "text"), "doc_id").join(X.query_texts(spark, d), "query_id")
    return V.excerpt(rows).select("query_id", "doc_id", "excerpt")


@query("SELECT query_id, b.rank, b.doc_id, 'Paragraph' AS type, m.year, m.title, count(*) OVER (PARTITION BY query_id) AS total FROM (SELECT * FROM bm25par WHERE rank <= 100) b JOIN paras p ON p.doc_id = b.doc_id JOIN meta m ON m.doc_id = p.paper_id QUALIFY b.rank BETWEEN 1 AND 10")
def search_paragraphs_page(spark, d):
    """A page of paragraph hits: their papers are found over the paragraphs, title and year over the papers."""
    return longs(V.search(X.paragraph_run(spark, d), X.metadata(spark, d), X.paragraphs(spark, d), X.query_texts(spark, d), "paragraph").drop("excerpt"))


@query(
    "SELECT query_id, rank, doc_id, 'Paragraph' AS type, year, title, total FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank, count(*) OVER (PARTITION BY query_id) AS total "
    "FROM (SELECT query_id, b.doc_id, b.rank AS place, m.year, m.title FROM bm25par b JOIN paras p USING (doc_id) JOIN meta m ON m.doc_id = p.paper_id WHERE b.rank <= 100 AND m.year >= 2050)) WHERE rank BETWEEN 11 AND 20"
)
def search_facets_page(spark, d):
    """The second page of the hits since a year."""
    return longs(V.search(X.paragraph_run(spark, d), X.metadata(spark, d), X.paragraphs(spark, d), X.query_texts(spark, d), "paragraph", 2, types=["Paragraph"], since=2050).drop("excerpt"))


@query("SELECT doc_id, 'Paper' AS type, title, year, abstract AS content FROM meta WHERE doc_id = '7' UNION ALL SELECT p.doc_id, 'Paragraph', m.title, m.year, p.text FROM paras p JOIN meta m ON m.doc_id = p.paper_id WHERE p.doc_id = '7_1'")
def document_preview(spark, d):
    return V.document("7", X.metadata(spark, d), X.paragraphs(spark, d)).unionByName(V.document("7_1", X.metadata(spark, d), X.paragraphs(spark, d), "paragraph"))


@query(
    "SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY first) - 1 AS pos FROM (SELECT query_id, word, min(i) AS first FROM (SELECT CAST(item_id AS VARCHAR) AS query_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(text, '[" + Q.SP + "]+'), lambda x: x <> '') AS ws FROM benchmark)) GROUP BY query_id, word) WHERE len(" + Q.tok("word") + ") > 0"
)
def query_vocabulary(spark, d):
    return V.query_vocabulary(X.query_texts(spark, d))


_WORDS = {"qw": "SELECT DISTINCT word FROM (SELECT unnest(list_filter(regexp_split_to_array(text, '[" + Q.SP + "]+'), lambda x: x <> '')) AS word FROM benchmark) WHERE len(" + Q.tok("word") + ") > 0"}


@query("SELECT word, lower(word) NOT IN (SELECT lower(word) FROM qw WHERE starts_with(word, 'th')) AS active FROM qw", _WORDS)
def vocabulary_merge(spark, d):
    words = V.query_vocabulary(X.query_texts(spark, d)).select("word").distinct()
    return V.merge_vocabulary(words, words.where("word like 'th%'").withColumn("active", F.lit(False)))


@query("SELECT word, 'query' AS kind, lower(word) NOT IN (SELECT lower(word) FROM qw WHERE starts_with(word, 'th')) AS active FROM qw UNION ALL SELECT 'Own Keyword', 'keyword', true", _WORDS)
def vocabulary_state(spark, d):
    """A user's words after a new query: what was switched off stays off, an own keyword stays, a removed one is gone."""
    words = V.query_vocabulary(X.query_texts(spark, d)).select("word").distinct()
    before = words.where("word like 'th%'").select("word", F.lit("query").alias("kind"), F.lit(False).alias("active"))
    state = V.add_keyword(V.add_keyword(V.vocabulary_state(words, before), " Own Keyword "), "other")
    return V.remove_keyword(V.toggle(V.toggle(state, "own keyword"), "own keyword"), "OTHER")


def _titles(spark, d):
    return X.table(spark, d, "part").select(F.col("p_partkey").alias("number"), F.col("p_name").alias("title"))


@query("SELECT p_partkey AS number, p_name AS title FROM part WHERE contains(lower(p_name), 're') ORDER BY p_partkey LIMIT 5")
def suggest(spark, d):
    return _suggestions(spark, d).suggest(" RE ")


@query("SELECT p_partkey AS number, p_name AS title FROM part WHERE contains(lower(p_name), 're') ORDER BY starts_with(lower(p_name), 're') DESC, p_partkey LIMIT 5")
def suggest_prefix_first(spark, d):
    return _suggestions(spark, d).suggest("re", prefix_first=True)


_GRAMS = "SELECT DISTINCT p_partkey AS number, unnest(list_transform(range(1, length(p_name) - {k} + 2), lambda i: substr(lower(p_name), i, {k}))) AS gram FROM part WHERE length(p_name) >= {k}"


@query("SELECT gram, count(*) AS n, min(number) AS first, max(number) AS last FROM (" + " UNION ALL ".join(_GRAMS.format(k=k) for k in (1, 2, 3)) + ") GROUP BY gram")
def suggestion_grams(spark, d):
    return longs(_suggestions(spark, d).grams.groupBy("gram").agg(F.sum(F.size("numbers")).alias("n"), F.min(F.array_min("numbers")).alias("first"), F.max(F.array_max("numbers")).alias("last")))


@X._kept
def _suggestions(spark, d):
    index = suggestions.build(_titles(spark, d))
    index.grams, index.titles = index.grams.persist(), index.titles.persist()
    return index


_FACETS = "SELECT doc_id, lang AS type, 2000 + CAST(doc_id AS BIGINT) % 25 AS year FROM papers"


def _facets(spark, d):
    return X.papers(spark, d).select("doc_id", F.col("lang").alias("type"), (2000 + F.col("doc_id").cast("long") % 25).alias("year"))


@query(f"SELECT * FROM ({_FACETS}) WHERE type IN ('de', 'fr') AND year >= 2015")
def facet_filter(spark, d):
    return V.facet_filter(_facets(spark, d), ["de", "fr"], 2015)


@query(f"SELECT type, count(*) AS n FROM ({_FACETS}) WHERE year >= 2015 GROUP BY type")
def facet_counts(spark, d):
    return V.facet_filter(_facets(spark, d), None, 2015).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS n FROM events GROUP BY 1")
def history_by_day(spark, d):
    return V.history_by_day(X.table(spark, d, "events")).withColumn("day", F.col("day").cast("string"))


@query("SELECT event_id, user_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 100")
def history_recent(spark, d):
    return longs(V.recent(X.table(spark, d, "events")).select("event_id", "user_id", "place"))


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) <> (SELECT CAST(min(ts) AS DATE) FROM events)")
def history_clear_day(spark, d):
    events = X.table(spark, d, "events")
    day = events.agg(F.to_date(F.min("ts")).alias("day"))
    return events.crossJoin(F.broadcast(day)).where(F.to_date("ts") != F.col("day")).select("event_id", "user_id")


_HISTORY = "SELECT event_id, user_id, event_type AS query, ts FROM events"


def _history(spark, d):
    return X.table(spark, d, "events").select("event_id", "user_id", F.col("event_type").alias("query"), "ts")


@query(f"SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM (SELECT * FROM ({_HISTORY}) WHERE event_id % 2 = 0 UNION ALL SELECT * FROM ({_HISTORY}) WHERE event_id % 2 = 1 AND event_id % 7 <> 0)) WHERE place <= 100")
def history_add(spark, d):
    """Half of the events are the history, the others are added; a seventh of these are blank."""
    h = _history(spark, d)
    new = h.where("event_id % 2 = 1").withColumn("query", F.when(F.col("event_id") % 7 == 0, "  ").otherwise(F.col("query")))
    return V.add_search(h.where("event_id % 2 = 0"), new).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE event_id % 3 <> 0")
def history_remove(spark, d):
    return V.remove_search(_history(spark, d), _history(spark, d).where("event_id % 3 = 0")).select("event_id", "user_id")


@query("SELECT event_id, user_id FROM events WHERE user_id % 5 <> 0")
def history_clear(spark, d):
    return V.clear_history(_history(spark, d), _history(spark, d).where("user_id % 5 = 0").select("user_id").distinct()).select("event_id", "user_id")


def _saved(spark, d):
    """Each event saves a document in the collection that its type names, in one of two letter cases."""
    name = F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type"))
    return X.table(spark, d, "events").select(name.alias("name"), (F.col("user_id") % 50).cast("string").alias("doc_id"), F.lit("paper").alias("collection"), "ts", "event_id", F.struct("ts", "event_id").alias("saved_at"))


_SAVED = {
    "sv": "SELECT lower(event_type) AS name, CAST(user_id % 50 AS VARCHAR) AS doc_id, ts, event_id FROM events",
    "sk": "SELECT name, doc_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY name, doc_id ORDER BY ts DESC, event_id DESC) AS n FROM sv) WHERE n = 1",
}


@query("SELECT * FROM sk", _SAVED)
def bookmark_dedupe(spark, d):
    """Documents saved again, under a name in another letter case, are the same."""
    s = _saved(spark, d)
    kept = V.save_document(s.where("event_id % 2 = 0"), s.where("event_id % 2 = 1"))
    return kept.select(F.lower("name").alias("name"), "doc_id", "event_id")


@query("SELECT * FROM sk WHERE NOT (name = (SELECT min(name) FROM sk) AND doc_id = '7')", _SAVED)
def bookmark_remove(spark, d):
    s = _saved(spark, d)
    kept = V.save_document(s.limit(0), s)
    first = s.agg(F.min(F.lower("name"))).first()[0]
    return V.remove_saved(kept, f" {first.upper()} ", "7", "paper").select(F.lower("name").alias("name"), "doc_id", "event_id")


@query("SELECT * FROM sk WHERE name <> (SELECT min(name) FROM sk)", _SAVED)
def bookmark_delete(spark, d):
    s = _saved(spark, d)
    return V.delete_saved(V.save_document(s.limit(0), s), s.agg(F.min(F.lower("name"))).first()[0].upper()).select(F.lower("name").alias("name"), "doc_id", "event_id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 4 = 0")
def saved_valid(spark, d):
    """Of four stored records one is whole: the others lack a name, a document's id, or the documents."""
    k = F.col("event_id") % 4
    document = F.struct(F.when(k != 1, F.lit("d")).alias("id"), F.lit("r").alias("result"), F.lit("paper").alias("searchCollection"), F.lit(False).alias("sampleData"), F.col("ts").alias("savedAt"))
    rows = X.table(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.when(k != 2, "n").otherwise(" ").alias("name"), F.when(k != 3, F.array(document)).alias("documents"))
    return V.saved_valid(rows).select("id")


@query(r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(title, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), lambda x: CASE WHEN lower(x) IN ('the', 'on', 'in') THEN '<mark>' || x || '</mark>' ELSE x END), '') AS marked FROM papers")
def highlight(spark, d):
    return X.papers(spark, d).select("doc_id", T.highlight(F.col("title"), ["the", "on", "in"]).alias("marked"))


_WORDS = r"SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{N}]+'))) AS w FROM benchmark"
_RUNS = r"SELECT doc_id, unnest(r) AS x, unnest(range(len(r))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}]+') AS r FROM papers)"


@query(f"SELECT doc_id, string_agg(CASE WHEN w IS NULL THEN x ELSE '<mark>' || x || '</mark>' END, '' ORDER BY i) AS marked FROM ({_RUNS}) LEFT JOIN ({_WORDS}) ON lower(x) = w GROUP BY doc_id")
def highlight_vocabulary(spark, d):
    """All words of all queries, in all texts."""
    words = X.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.TOKEN), F.lit(0))).alias("w")).distinct()
    return X.papers(spark, d).select("doc_id", T.highlight(F.col("text"), [r["w"] for r in words.collect()], few=0).alias("marked"))
