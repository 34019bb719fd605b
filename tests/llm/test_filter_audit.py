from itertools import permutations

import duckdb

from rankloom.llm import filter_audit as A

from .conftest import prose


def by_hand(rows, labels):
    """Every order walked document by document. rows: (doc_id, text, lang); labels: id to (quality, toxic)."""
    import re

    found = []
    for d, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, x in zip("ABCDE", (len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search("[#$%&*|]", t)),
                                             any((u or "") == t and (e is None and d is not None or e is not None and d is not None and e < d) for e, u, _ in rows))) if x}
        found.append((lang or "", fails, *labels.get(d, (None, None))))
    out = {}
    for part in {x[0] for x in found}:
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [x for x in found if x[0] == part]
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                stay = [x for x in left if f not in x[1]]
                everyone = [x for x in found if x[0] == part and f in x[1]]
                out[part, "".join(order), k] = [len(stay), len(gone), len(everyone) - len(gone), sum(x[1] == {f} for x in everyone), sum(x[2] == 1 for x in gone), sum(x[3] == 1 for x in gone)]
                total[f] += len(gone)
                left = stay
        for (p, order, k), v in out.items():
            if p == part:
                v.append(total[order[k - 1]])
    return out


def answer(df):
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in df.collect()}


def test_query_equals_sql(spark, sf):
    c = duckdb.connect()
    for t in ("documents", "labels"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = A.op12(spark, sf)
    assert sorted(map(tuple, got.collect())) == sorted(c.sql(A.SQL).fetchall())
    assert got.columns == [x[0] for x in c.sql(A.SQL).description]


def test_orders_walked_by_hand(spark):
    long, loud, same = prose(1, 240), prose(2, 240).upper(), " ".join(["again"] * 250)
    rows = [(1, long, "en"), (2, long, "en"), (3, long, "de"), (4, loud, "en"), (5, same, "en"), (6, same + " #", "en"), (7, "short", "en"), (8, loud + " |", None),
            (9, None, ""), (10, "", "en"), (2, long, "en"), (1, long, "en"), (None, same, "de"), (11, "SHORT $", "de"), (12, prose(3, 300), "fr")]
    labels = {1: (1, 0), 2: (1, 1), 4: (0, 1), 5: (1, None), 7: (None, 1), 12: (1, 0)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame([(d, *x) for d, x in labels.items()] + [(None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    got = answer(A.audit(docs, marks))
    assert got == by_hand(rows, labels) and len(got) == 600 * 4


def test_polynomial():
    counts = {0: 5, 0b11: 6, 0b100: 2, 0b10101: 3, 0b11111: 1}
    r = A.removal(counts)
    for s in range(32):
        assert A.corner(r, s) == sum(n for m, n in counts.items() if m & s)
    assert sum(A.shapley(r, i) for i in range(5)) == 12 and A.shapley(r, 0) == A.Fraction(6, 2) + A.Fraction(3, 3) + A.Fraction(1, 5)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = answer(A.audit(odd, labels))
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in odd.collect()]
    assert got == by_hand(rows, {})
    assert A.audit(none, labels).count() == 0
