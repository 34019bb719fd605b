"""DuckDB SQL of the engine's queries, put together from named steps."""

from __future__ import annotations

from rankloom.functions import stem, stopwords
from rankloom.operators.ranking import TUNED


def literal(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


SW = literal(stopwords.build())
SW_BASE = literal(stopwords.build(keep=("not", "no")))
SP = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def tok(t: str) -> str:
    return rf"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}]+'), lambda x: length(x) >= 2 AND NOT regexp_full_match(x, '\p{{Nd}}+') AND NOT list_contains({SW}, x))"


def _ending(w: str, endings) -> str:
    """The longest of the endings that w has, or ''."""
    return "CASE " + " ".join(f"WHEN suffix({w}, '{e}') THEN '{e}'" for e in sorted(endings, key=lambda e: (-len(e), e))) + " ELSE '' END"


def stem_steps(words: str = "voc") -> dict[str, str]:
    """Steps that stem the column term of `words` after Porter2; the last one, stems, has term and s. One rule after the other, as in the
    published description: regular expressions without lookaround, on all words at once."""
    v = "aeiouy"
    region = f"regexp_extract({{}}, '^.*?[{v}][^{v}]')"
    short = f"(regexp_matches({{0}}, '[^{v}][{v}][^{v}wxY]$') OR regexp_full_match({{0}}, '[{v}][^{v}]'))"
    quoted = lambda ws: ", ".join(f"'{w}'" for w in sorted(ws))
    chosen = lambda col, table: f"CASE {col} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + " END"
    base = "left(w, length(w) - length(e))"
    two, three, four = [*stem._STEP2, "ogi", "li"], [*stem._STEP3, "ative"], [*stem._STEP4, "ion"]
    return {
        "st0": f"SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '([{v}])y', '\\1Y', 'g') AS w FROM {words} WHERE length(term) > 2 AND term NOT IN ({quoted(stem._SPECIAL)})",
        "st1": f"SELECT term, w, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)') THEN length(regexp_extract(w, '^(gener|commun|arsen)')) WHEN {region.format('w')} = '' THEN length(w) ELSE length({region.format('w')}) END AS r1 FROM st0",
        "st2": f"SELECT *, CASE WHEN {region.format('substr(w, r1 + 1)')} = '' THEN length(w) ELSE r1 + length({region.format('substr(w, r1 + 1)')}) END AS r2 FROM st1",
        "st3": f"SELECT term, r1, r2, CASE WHEN suffix(w, 'sses') THEN left(w, length(w) - 2) WHEN suffix(w, 'ied') OR suffix(w, 'ies') THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END) WHEN suffix(w, 's') AND NOT suffix(w, 'us') AND NOT suffix(w, 'ss') AND regexp_matches(left(w, length(w) - 1), '[{v}].') THEN left(w, length(w) - 1) ELSE w END AS w FROM st2",
        "st4": f"SELECT *, w IN ({quoted(stem._AFTER_1A)}) AS done, {_ending('w', ('eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'))} AS e FROM st3",
        "st5": f"SELECT term, r1, r2, done, w, e, {base} AS x FROM st4",
        "st6": f"SELECT term, r1, r2, done, CASE WHEN done OR e = '' THEN w WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(x) >= r1 THEN x || 'ee' ELSE w END WHEN NOT regexp_matches(x, '[{v}]') THEN w WHEN regexp_matches(x, '(at|bl|iz)$') THEN x || 'e' WHEN regexp_matches(x, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(x, length(x) - 1) WHEN r1 >= length(x) AND {short.format('x')} THEN x || 'e' ELSE x END AS w FROM st5",
        "st7": f"SELECT term, r1, r2, done, CASE WHEN done THEN w ELSE regexp_replace(w, '(.[^{v}])[yY]$', '\\1i') END AS w FROM st6",
        "st8": f"SELECT *, {_ending('w', two)} AS e FROM st7",
        "st9": f"SELECT term, r1, r2, done, CASE WHEN done OR e = '' OR length(x) < r1 THEN w WHEN e = 'ogi' THEN CASE WHEN suffix(x, 'l') THEN x || 'og' ELSE w END WHEN e = 'li' THEN CASE WHEN regexp_matches(x, '[cdeghkmnrt]$') THEN x ELSE w END ELSE x || {chosen('e', stem._STEP2)} END AS w FROM (SELECT *, {base} AS x FROM st8)",
        "st10": f"SELECT *, {_ending('w', three)} AS e FROM st9",
        "st11": f"SELECT term, r1, r2, done, CASE WHEN done OR e = '' THEN w WHEN e = 'ative' THEN CASE WHEN length(x) >= r2 THEN x ELSE w END WHEN length(x) >= r1 THEN x || {chosen('e', stem._STEP3)} ELSE w END AS w FROM (SELECT *, {base} AS x FROM st10)",
        "st12": f"SELECT *, {_ending('w', four)} AS e FROM st11",
        "st13": f"SELECT term, r1, r2, done, CASE WHEN done OR e = '' OR length(x) < r2 OR e = 'ion' AND NOT regexp_matches(x, '[st]$') THEN w ELSE x END AS w FROM (SELECT *, {base} AS x FROM st12)",
        "st14": f"SELECT term, CASE WHEN done THEN w WHEN suffix(w, 'e') AND (length(x) >= r2 OR length(x) >= r1 AND NOT {short.format('x')}) THEN x WHEN suffix(w, 'll') AND length(x) >= r2 THEN x ELSE w END AS w FROM (SELECT *, left(w, length(w) - 1) AS x FROM st13)",
        "stems": f"SELECT term, replace(w, 'Y', 'y') AS s FROM st14 UNION ALL SELECT term, coalesce({chosen('term', stem._SPECIAL)}, term) FROM {words} WHERE length(term) <= 2 OR term IN ({quoted(stem._SPECIAL)})",
    }


#: Steps by name; a step may use those before it. Each becomes a common table expression.
STEPS = {
    "papers": f"SELECT CAST(doc_id AS VARCHAR) AS doc_id, split_part(text, chr(10), 1) AS title, text, source, lang, {tok('text')} AS tokens FROM documents",
    "paras": f"SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(pos AS VARCHAR) AS doc_id, CAST(doc_id AS VARCHAR) AS paper_id, pos, text, {tok('text')} AS tokens FROM (SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS pos, unnest(ls) AS text FROM (SELECT doc_id, str_split(text, chr(10)) AS ls FROM documents))",
    "papers_full": "SELECT * FROM papers WHERE len(tokens) > 0",
    "paras_full": "SELECT * FROM paras WHERE len(tokens) > 0",
    "q": f"SELECT CAST(item_id AS VARCHAR) AS query_id, text AS query, CASE WHEN item_id % 10 <= 2 THEN 'Easy' WHEN item_id % 10 <= 7 THEN 'Medium' ELSE 'Hard' END AS label, {tok('text')} AS tokens FROM benchmark",
    "held": "SELECT CAST(b.item_id AS VARCHAR) AS query_id, CAST(d.doc_id AS VARCHAR) AS doc_id, d.text FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
    "near": "SELECT DISTINCT a.query_id, b.doc_id FROM (SELECT query_id, unnest(str_split(text, chr(10))) AS line FROM held) a JOIN (SELECT CAST(doc_id AS VARCHAR) AS doc_id, unnest(str_split(text, chr(10))) AS line FROM documents) b ON a.line = b.line AND length(a.line) >= 60",
    "qrels": "SELECT query_id, doc_id, 2 AS grade FROM held UNION ALL SELECT query_id, doc_id, 1 FROM near n WHERE NOT EXISTS (SELECT 1 FROM held h WHERE h.query_id = n.query_id AND h.doc_id = n.doc_id)",
}


_LISTS = "SELECT {0}, list(s ORDER BY i) AS tokens FROM (SELECT {0}, unnest(tokens) AS term, unnest(range(len(tokens))) AS i FROM {1}) JOIN stems USING (term) GROUP BY {0} UNION ALL SELECT {0}, CAST([] AS VARCHAR[]) FROM {1} WHERE len(tokens) = 0"
# the words of paragraphs are those of their papers
STEPS |= {"voc": "SELECT DISTINCT term FROM (SELECT unnest(tokens) AS term FROM papers UNION ALL SELECT unnest(tokens) FROM q)"} | stem_steps()
STEPS |= {
    "qt": "SELECT query_id, s AS term, count(*) AS qtf FROM (SELECT query_id, unnest(tokens) AS term FROM q) JOIN stems USING (term) GROUP BY query_id, s",
    "papers_s": _LISTS.format("doc_id", "papers"),
    "paras_s": _LISTS.format("doc_id", "paras"),
    "pheld": "SELECT CAST(b.item_id AS VARCHAR) AS query_id, p.doc_id, p.text FROM paras p JOIN benchmark b ON contains(p.text, b.text)",
    "pqrels": "SELECT query_id, doc_id, 2 AS grade FROM pheld UNION ALL SELECT DISTINCT a.query_id, b.doc_id, 1 FROM pheld a JOIN paras b ON a.text = b.text AND length(a.text) >= 60 WHERE NOT EXISTS (SELECT 1 FROM pheld h WHERE h.query_id = a.query_id AND h.doc_id = b.doc_id)",
    "meta": "SELECT p.doc_id, p.title, a.text AS abstract, 2000 + CAST(p.doc_id AS BIGINT) % 100 AS year FROM papers p LEFT JOIN paras a ON a.doc_id = p.doc_id || '_1'",
}


def index(name: str, rows: str, stemmed: bool = True) -> dict[str, str]:
    """Index tables of a collection."""
    flat = f"SELECT doc_id, unnest(tokens) AS term FROM {rows}"
    return {
        f"{name}_p": f"SELECT s AS term, doc_id, count(*) AS tf FROM ({flat}) JOIN stems USING (term) GROUP BY s, doc_id" if stemmed else f"SELECT term, doc_id, count(*) AS tf FROM ({flat}) GROUP BY term, doc_id",
        f"{name}_d": f"SELECT doc_id, CAST(len(tokens) AS BIGINT) AS doc_length FROM {rows}",
        f"{name}_c": f"SELECT count(*) AS num_docs, avg(doc_length) AS avg_doc_length FROM {name}_d",
        f"{name}_t": f"SELECT term, df, cf, ln(1 + (num_docs - df + 0.5) / (df + 0.5)) AS idf, num_docs FROM (SELECT term, count(*) AS df, sum(tf) AS cf FROM {name}_p GROUP BY term), {name}_c",
    }


def ranked(scores: str, k: int, by: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, doc_id) AS rank FROM ({scores})) WHERE rank <= {k}"


def bm25_scores(name: str, k1: float, b: float, terms: str = "qt") -> str:
    return f"SELECT query_id, doc_id, round(sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * doc_length / avg_doc_length))), 6) AS score FROM {terms} JOIN {name}_p USING (term) JOIN {name}_t USING (term) JOIN {name}_d USING (doc_id), {name}_c GROUP BY query_id, doc_id"


def bm25(name: str, k: int, k1: float, b: float, terms: str = "qt") -> str:
    return ranked(bm25_scores(name, k1, b, terms), k)


STEPS |= index("pap", "papers_full") | index("par", "paras_full")
STEPS |= {
    "bm25": bm25("pap", 100, *TUNED["paper"]),
    "bm25par": bm25("par", 2000, *TUNED["paragraph"]),
}


def tfidf_steps(name: str) -> dict[str, str]:
    return {
        f"{name}_w": f"SELECT term, doc_id, (1 + log10(tf)) * log10(num_docs / df) AS w, log10(num_docs / df) AS tidf FROM {name}_p JOIN {name}_t USING (term) WHERE log10(num_docs / df) > 0",
        f"{name}_n": f"SELECT doc_id, sqrt(sum(w * w)) AS norm FROM {name}_w GROUP BY doc_id",
        f"{name}_qw": f"SELECT query_id, term, (1 + log10(qtf)) * log10(num_docs / df) AS qw FROM qt JOIN {name}_t USING (term) WHERE log10(num_docs / df) > 0",
        f"{name}_qn": f"SELECT query_id, sqrt(sum(qw * qw)) AS qnorm FROM {name}_qw GROUP BY query_id",
        f"{name}_tfidf": ranked(f"SELECT query_id, doc_id, round(sum(w * qw) / any_value(norm) / any_value(qnorm), 6) AS score FROM {name}_w JOIN {name}_qw USING (term) JOIN {name}_n USING (doc_id) JOIN {name}_qn USING (query_id) GROUP BY query_id, doc_id", 100),
    }


STEPS |= tfidf_steps("pap") | tfidf_steps("par")
DOT = "list_sum(list_transform(range(1, 65), lambda i: CAST({a}[i] AS DOUBLE) * CAST({b}[i] AS DOUBLE)))"
STEPS |= {
    "sw": "SELECT term, doc_id, ln(1 + tf) * idf AS weight FROM pap_p JOIN pap_t USING (term)",
    "sparse": ranked("SELECT query_id, doc_id, round(sum(weight * ln(1 + qtf)), 6) AS score FROM qt JOIN sw USING (term) GROUP BY query_id, doc_id HAVING sum(weight * ln(1 + qtf)) > 0", 100),
    "vec": "SELECT CAST(vec_id AS VARCHAR) AS doc_id, embedding AS vector, label FROM embeddings",
    "vq": "SELECT CAST(vec_id AS VARCHAR) AS query_id, embedding AS qv FROM embeddings WHERE vec_id % 20 = 0",
    "densefull": "SELECT query_id, doc_id, round(" + DOT.format(a="vector", b="qv") + ", 6) AS score FROM vec, vq",
    "dense": ranked("SELECT * FROM densefull", 100),
}


def rrf(*names: str) -> str:
    every = " UNION ALL ".join(f"SELECT query_id, doc_id, rank FROM {n} WHERE rank <= 100" for n in names)
    return ranked(f"SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM ({every}) GROUP BY query_id, doc_id", 100)


def _runs(each: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{m}' AS model, query_id, doc_id, score, rank FROM {r} WHERE rank <= 100" for m, r in each.items())


STEPS |= {
    "rrfpap": rrf("bm25", "pap_tfidf"),
    "rrfpar": rrf("bm25par", "par_tfidf"),
    "runs": _runs({"bm25": "bm25", "sparse": "sparse", "tfidf": "pap_tfidf", "rrf:bm25+tfidf": "rrfpap"}),
    "pruns": _runs({"bm25": "bm25par", "tfidf": "par_tfidf", "rrf:bm25+tfidf": "rrfpar"}),
}


def metric_steps(run: str, qrels: str = "qrels", by: str = "") -> dict[str, str]:
    """Step m: all metrics by judged query, of `run`; with by='model, ' for each model."""
    gain = {0: "grade", 1: "(power(2, grade) - 1)"}
    d = ", ".join(f"sum(CASE WHEN rank <= {n} THEN {gain[e]} / log2(rank + 1) ELSE 0 END) AS {{}}{e}_{n}" for n in (5, 10, 100) for e in (0, 1))
    key = "model, query_id" if by else "query_id"
    every = "SELECT model, query_id FROM (SELECT DISTINCT model FROM " + run + "), (SELECT DISTINCT query_id FROM " + qrels + ")" if by else f"SELECT DISTINCT query_id FROM {qrels}"
    share = lambda a, b: f"coalesce(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} END, 0.0)"
    return {
        "rows_": f"SELECT r.*, coalesce(j.grade, 0) AS grade FROM {run} r LEFT JOIN {qrels} j ON r.query_id = j.query_id AND r.doc_id = j.doc_id WHERE rank <= 100",
        "found": f"SELECT {key}, " + ", ".join(f"count(*) FILTER (WHERE grade >= 1 AND rank <= {n}) AS h{n}" for n in (1, 5, 10, 100)) + ", min(rank) FILTER (WHERE grade >= 1) AS first, " + d.format(*["d"] * 6) + f" FROM rows_ GROUP BY {key}",
        "best": "SELECT query_id, " + d.format(*["i"] * 6) + f" FROM (SELECT query_id, grade, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS rank FROM {qrels} WHERE grade > 0) GROUP BY query_id",
        "rel": f"SELECT query_id, count(*) FILTER (WHERE grade >= 1) AS relevant FROM {qrels} GROUP BY query_id",
        "m": f"SELECT e.*, {share('d0_100', 'i0_100')} AS ndcg, {share('d0_5', 'i0_5')} AS ndcg_at_5, {share('d0_10', 'i0_10')} AS ndcg_at_10, {share('d1_100', 'i1_100')} AS ndcg_exp, {share('d1_5', 'i1_5')} AS ndcg_exp_at_5, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(CASE WHEN first <= 10 THEN 1.0::DOUBLE / first END, 0) AS mrr_at_10, coalesce(h5 / 5.0::DOUBLE, 0) AS p_at_5, coalesce(h10 / 10.0::DOUBLE, 0) AS p_at_10, {share('h5', 'relevant')} AS recall_at_5, {share('h10', 'relevant')} AS recall_at_10, {share('h100', 'relevant')} AS recall_at_100, "
        + ", ".join(f"CASE WHEN coalesce(h{n}, 0) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy_at_{n}" for n in (1, 5, 10))
        + f" FROM ({every}) e LEFT JOIN found USING ({key}) LEFT JOIN best USING (query_id) LEFT JOIN rel USING (query_id)",
    }


def build(body: str, extra: dict[str, str] | None = None) -> str:
    """body with the steps that it needs, in order."""
    import re

    steps = STEPS | (extra or {})
    need: set[str] = set()

    def visit(sql: str) -> None:
        for name in set(re.findall(r"\b[a-z][a-z0-9_]*\b", sql)) & set(steps) - need:
            need.add(name)
            visit(steps[name])

    visit(body)
    # every step only names earlier ones, or extra ones after all
    ctes = ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in steps.items() if n in need)
    return f"WITH {ctes} {body}" if ctes else body
