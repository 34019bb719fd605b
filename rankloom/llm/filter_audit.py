"""Operator 12, filter interaction audit: what each of five filters removes, in every order, and its Shapley share, per part of a corpus.

A document is the set of filters that it fails, five bits. Documents are counted by part and bits, all of them, those labelled good, and those
labelled toxic; 32 counts a part are all that the rest needs. They are the coefficients of a multilinear polynomial: R(x) is the number
of documents removed if filter i is there with probability x_i, one less each document's product of (1 - x_i) over the filters that it
fails. At the corners of the cube R gives what any set of filters removes, hence the survivors of every prefix of every order. The integral of
its partial derivative along the diagonal, in exact rationals, is a filter's Shapley value: its mean removal over all orders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table, work_dir, written

FILTERS = "ABCDE"
#: A: fewer words; B: percent of words that are distinct; C: percent of characters that are capitals; D: any of these.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, SYMBOLS = 200, 50, 3, b"#$%&*|"
_CAPITALS, _CONTINUATION = bytes(range(65, 91)), bytes(range(0x80, 0xC0))


def failed_by_text(raw: bytes) -> int:
    """Bits of the filters A to D that a text fails, A lowest. Words are split at ASCII white space, as bytes.split() does."""
    words = raw.split()
    n = len(words)
    size = len(raw.translate(None, _CONTINUATION))
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    bits = (n < LEAST_WORDS) | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1 | (100 * capitals > MOST_CAPITALS * size) << 2
    return bits | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3


def failed(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, part, failed (bits of FILTERS) per row. A row fails E if a smaller doc_id has the same text; null ids are the smallest.

    Texts are the same if 128 bits of their SHA-256 are. The first id of a text is a partial aggregate, and rows are matched with it by
    text and id, so that a text that many rows share is no task of its own.
    """

    def measured(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for k in range(0, b.num_rows, 1000):
                texts = [t or b"" for t in b.column(2).slice(k, 1000).to_pylist()]
                bits, keys = [failed_by_text(t) for t in texts], [hashlib.sha256(t).digest()[:16] for t in texts]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1000), b.column(1).slice(k, 1000), pa.array(keys, pa.binary()), pa.array(bits, pa.int32())], ["doc_id", "part", "key", "bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").cast("binary").alias("text"))
    rows = written(rows.mapInArrow(measured, f"doc_id {kind}, part string, key binary, bits int"), f"{path}/failed")
    firsts = rows.groupBy("key").agg(F.min(F.struct("doc_id")).alias("first")).select(F.col("key").alias("f_key"), F.col("first.doc_id").alias("f_id"), F.lit(0).alias("again"))
    seen = rows.join(firsts, (F.col("key") == F.col("f_key")) & F.col("doc_id").eqNullSafe(F.col("f_id")), "left")
    return seen.select("doc_id", "part", F.col("bits").bitwiseOR(F.coalesce("again", F.lit(16))).alias("failed"))


def removal(counts: dict[int, int]) -> dict[int, int]:
    """Coefficients of the removal polynomial, by the set of variables of each monomial, from the numbers of documents by failed filters."""
    sets = range(1, 1 << len(FILTERS))
    return {s: (-1) ** (s.bit_count() + 1) * sum(n for m, n in counts.items() if m & s == s) for s in sets}


def corner(coefficients: dict[int, int], filters: int) -> int:
    """The polynomial where the variables of `filters` are 1 and the others 0: what that set of filters removes."""
    return sum(c for s, c in coefficients.items() if s & filters == s)


def shapley(coefficients: dict[int, int], i: int) -> Fraction:
    """The integral over t from 0 to 1 of the partial derivative in x_i at (t, ..., t). A monomial of k variables, x_i among them, gives c / k."""
    return sum((Fraction(c, s.bit_count()) for s, c in coefficients.items() if s >> i & 1), Fraction(0))


def steps(counts: list[tuple[int, int, int, int]]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and step, from (failed,
    documents, good, toxic) of a part."""
    whole, good, toxic = (removal({row[0]: row[k] for row in counts}) for k in (1, 2, 3))
    every, size = (1 << len(FILTERS)) - 1, sum(row[1] for row in counts)
    gone, gone_good, gone_toxic = ([corner(r, s) for s in range(every + 1)] for r in (whole, good, toxic))
    shares = [shapley(whole, i) * factorial(len(FILTERS)) for i in range(len(FILTERS))]
    assert all(x.denominator == 1 for x in shares)
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for k, i in enumerate(order, 1):
            after = before | 1 << i
            here = gone[after] - gone[before]
            out.append((name, k, size - gone[after], here, gone[1 << i] - here, gone[every] - gone[every & ~(1 << i)], gone_good[after] - gone_good[before], gone_toxic[after] - gone_toxic[before], int(shares[i])))
            before = after
    return out


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part (lang), order of the five filters, and step. See SCHEMA; shapley is the filter's removal summed over all 120 orders.

    Null texts are empty: they fail A, and E if another empty text came before. Null lang is the part of the empty string. Each row counts,
    repeated rows too: rows with the smallest id of a text do not fail E, all others do; a null id is the smallest. A document is good or toxic
    if any of its labels says so; labels of null ids are of no document. An empty table gives no parts and no rows; empty labels, zeros. Other
    columns are not looked at.
    """
    path = work_dir(docs.sparkSession)
    marks = labels.groupBy(F.col("doc_id").alias("l_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    rows = failed(docs, path)
    rows = rows.join(marks, F.col("doc_id") == F.col("l_id"), "left")
    one = lambda c: F.sum(F.coalesce(F.col(c), F.lit(False)).cast("long"))
    counts = rows.groupBy("part", "failed").agg(F.count("*").alias("n"), one("good").alias("good"), one("toxic").alias("toxic"))
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("counts"))

    def ordered(batches: Iterator) -> Iterator:
        import pyarrow as pa

        names = [x.split()[0] for x in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in SCHEMA.split(", ")])
        for b in batches:
            for row in b.to_pylist():
                found = [(row["part"], *s) for s in steps([(c["failed"], c["n"], c["good"], c["toxic"]) for c in row["counts"]])]
                yield pa.RecordBatch.from_arrays([pa.array(col, schema.field(n).type) for n, col in zip(names, zip(*found))], schema=schema)

    return parts.mapInArrow(ordered, SCHEMA)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_LETTERS = "(VALUES ('A', 0), ('B', 1), ('C', 2), ('D', 3), ('E', 4)) AS {0}({0}, {0}n)"
_BEFORE = "CASE WHEN step > {k} THEN 1 << CAST(instr('ABCDE', filter_order[{k}]) - 1 AS INT) ELSE 0 END"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^ \\t-\\r]+') AS ws FROM d),
f AS (SELECT doc_id, part, CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
  + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 3 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
  + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS m FROM w),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, m, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, m),
o AS (SELECT a || b || c || d || e AS filter_order FROM {', '.join(_LETTERS.format(x) for x in 'abcde')}
  WHERE (1 << an) + (1 << bn) + (1 << cn) + (1 << dn) + (1 << en) = 31 AND an + bn + cn + dn + en = 10 AND len(list_distinct([a, b, c, d, e])) = 5),
s AS (SELECT filter_order, step, 1 << CAST(instr('ABCDE', filter_order[step]) - 1 AS INT) AS f, {' + '.join(_BEFORE.format(k=k) for k in range(1, 5))} AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f, sum(CASE WHEN m & (before | f) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN m & before = 0 AND m & f <> 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN m & before <> 0 AND m & f <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN m = f THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN m & before = 0 AND m & f <> 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN m & before = 0 AND m & f <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r
"""
