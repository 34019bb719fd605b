"""Operator 7, personal data by weak supervision, in DataFrame functions only.

Base spans come from strict patterns with validators, and stay whatever the method says. Looser patterns propose further spans where no
base span is: obfuscated addresses, IPv6, card numbers inside longer runs of digits, numbers without a country, and secrets such as access
tokens. Five labelers (pattern, gazetteer, context, boundary, arithmetic) vote on every candidate: 1, -1, or 0 for no opinion.
Expectation-maximisation over the counts of vote patterns of all documents estimates the labelers' reliabilities; its posteriors train a
logistic span classifier, which decides on the loose candidates, from the probability on at which those it takes are right to PRECISION by
the posteriors. What the driver sees are counts of vote patterns: at most some thousand rows for any corpus.

Work is linear in a text's length and, up to BLOCK matches at a time, in its matches.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table, work_dir, written

KINDS = ("email", "ip", "card", "phone")
#: With the kind that has loose candidates alone.
ALL_KINDS = (*KINDS, "secret")
#: Share of the added spans that should be right, by the posteriors; characters before a span that are its context; matches whose places are
#: summed at a time.
PRECISION, CONTEXT, BLOCK = 0.8, 32, 64
#: Share of a labeler's votes that are for the candidate, if it is right and if it is wrong, as thought beforehand; the part of a kind's
#: candidates that this counts for.
WORTH = {"pattern": (0.95, 0.05), "gazetteer": (0.9, 0.3), "context": (0.95, 0.1), "boundary": (0.97, 0.7), "arithmetic": (0.97, 0.6)}
PRIOR = 0.05

_LOCAL = r"A-Za-z0-9._%+-"
#: kind: (must hold before the pattern is tried, pattern). Quantifiers are possessive where nothing that follows could need a character
#: back, and runs are entered at their first character alone (or where the last match ended), so that long runs cost linear time.
BASE = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9][\x20-]?[0-9]", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_OCTET = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_AT, _DOT = r"\x20?[\[(]\x20?(?:at|AT)\x20?[\])]\x20?", r"\x20?[\[(]\x20?(?:dot|DOT)\x20?[\])]\x20?"
LOOSE = {
    "email": (r"[\[(]\x20?(?:at|AT)\x20?[\])]|\x20dot\x20", rf"(?<![{_LOCAL}])[A-Za-z0-9._%+-]{{1,64}}+(?:{_AT}|\x20at\x20(?=[A-Za-z0-9-]{{1,63}}\x20dot\x20))[A-Za-z0-9-]{{1,63}}(?:(?:\.|{_DOT}|\x20dot\x20)[A-Za-z]{{2,10}}){{1,4}}"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
    "card": (r"[0-9]{4}[\x20-]?[0-9]{4}", r"(?<![0-9])(?:3[47][0-9]{2}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}|[0-9]{16}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"),
    "phone": (r"[0-9]{3}[\x20.-][0-9]{4}", r"(?<![0-9+.-])\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-]?[0-9])"),
    "secret": (r"[A-Za-z0-9_+/-]{16}", r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[A-Za-z0-9_+/-]{16,}+={0,2}"),
}
#: Gazetteer, fixed values: endings of mail domains, and words that stand before each kind or before other numbers.
ENDINGS = "com|org|net|edu|gov|info|io|de|fr|es|it|nl|uk|eu|ch|at|be|us"
CUES = {
    "email": "mail|contact|write|reach|kontakt|courriel|correo",
    "ip": "ip|ipv6|host|server|address|adresse|client",
    "card": "card|visa|amex|american express|credit|karte|carte|tarjeta",
    "phone": "phone|tel|call|mobile|cell|fax|anruf|telefon|appel|llame",
    "secret": "token|secret|password|passwd|pwd|key|api_key|apikey|access_key|auth|bearer|credential|credentials",
}
AGAINST = "version|isbn|sku|serial|order|invoice|ref|figure|total|price|token|password|key|id"
NO_SECRET = "sha1|sha256|md5|commit|checksum|hash|digest|uuid|etag|revision"
#: Beginnings of issued tokens, and lengths of hexadecimal ones.
TOKENS = "AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|pk_|xox[abp]-|AIza|eyJ"


def _let(value: Column, f) -> Column:
    """f(value), with the value made once: what a lambda names otherwise is made again for each element."""
    return F.transform(F.array(value), f)[0]


def _found(text: Column, guard: str, pattern: str) -> Column:
    """array<struct<start, stop, s, before, left, right>>: the leftmost non-overlapping matches, in code points, end exclusive.

    What stands between matches gives the places: split() cuts where the matches are. It also gives what is around a match, but for what the
    matches beside it hold: before (CONTEXT characters), left and right (one character; a space at the text's ends and beside a match).
    Places are summed in blocks of BLOCK matches, then over the blocks, so that no long array is copied once for each match.
    """
    none = F.expr("cast(array() as array<string>)")
    empty = F.expr("cast(array() as array<struct<start:int,stop:int,s:string,before:string,left:string,right:string>>)")

    def sides(x):
        g, after = x["g"], x["n"]
        return F.struct(
            F.length(g).alias("skip"), F.length(x["h"]).alias("long"), x["h"].alias("s"), F.lower(F.substring(g, -CONTEXT, CONTEXT)).alias("before"),
            F.when(F.length(g) > 0, F.substring(g, -1, 1)).otherwise(F.lit(" ")).alias("left"), F.when(F.length(after) > 0, F.substring(after, 1, 1)).otherwise(F.lit(" ")).alias("right"),
        )

    def sums(steps: Column) -> Column:
        """array<int>: what comes before each step."""
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(steps, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    whole = lambda x: x["skip"] + x["long"]
    place = lambda x, at: F.struct((at + x["skip"]).alias("start"), (at + whole(x)).alias("stop"), x["s"].alias("s"), x["before"].alias("before"), x["left"].alias("left"), x["right"].alias("right"))
    placed = lambda own, base: F.zip_with(own, sums(F.transform(own, whole)), lambda x, at: place(x, base + at))
    cut = lambda rows: F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int")), lambda k: F.slice(rows, k * BLOCK + 1, F.lit(BLOCK)))
    joined = lambda blocks: F.flatten(F.zip_with(blocks, sums(F.transform(blocks, lambda own: F.aggregate(own, F.lit(0), lambda acc, x: acc + whole(x)))), placed))
    zipped = lambda h: _let(F.split(text, pattern, -1), lambda g: F.transform(F.arrays_zip(F.slice(g, 1, F.size(h)).alias("g"), h.alias("h"), F.slice(g, 2, F.size(h)).alias("n")), sides))
    hits = F.when(text.rlike(guard), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none)
    return _let(hits, lambda h: F.when(F.size(h) > 0, _let(zipped(h), lambda rows: _let(cut(rows), joined))).otherwise(empty))


def _apart(xs: Column, ys: Column, also=None) -> Column:
    """The xs that meet none of ys for which also(x, y) holds. ys are dealt to as many cells of the text as the root of their number, and
    each x is held against those of its own cells."""
    meet = lambda x, y: (x["start"] < y["stop"]) & (y["start"] < x["stop"]) & (also(x, y) if also else F.lit(True))

    def cells(y):
        n = F.ceil(F.sqrt(F.size(y).cast("double"))).cast("int")
        width = F.greatest(F.lit(1), F.ceil((F.array_max(F.transform(y, lambda v: v["stop"])) + 1) / n).cast("int"))
        return F.struct(width.alias("w"), _let(width, lambda w: F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.filter(y, lambda v: (v["start"] < (c + 1) * w) & (v["stop"] > c * w)))).alias("c"))

    def left(x, t):
        first = F.floor(x["start"] / t["w"]).cast("int")
        own = F.slice(t["c"], first + 1, F.floor((x["stop"] - 1) / t["w"]).cast("int") - first + 1)
        return ~F.exists(own, lambda some: F.exists(some, lambda y: meet(x, y)))

    both = lambda s: F.when((F.size(s["x"]) == 0) | (F.size(s["y"]) == 0), s["x"]).otherwise(_let(cells(s["y"]), lambda t: F.filter(s["x"], lambda x: left(x, t))))
    return _let(F.struct(xs.alias("x"), ys.alias("y")), both)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _valid(kind: str, s: Column) -> Column:
    if kind == "ip":
        return s.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.length(_digits(s)).between(16, 19) & F.call_function("luhn_check", _digits(s))
    if kind == "phone":
        return F.length(_digits(s)).between(8, 15)
    return F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, F.lit(1)).when(bad, F.lit(-1)).otherwise(F.lit(0))


VOTES = ["pattern", "gazetteer", "context", "boundary", "arithmetic"]
TRAITS = ["parted", "long", "line_start"]


def _judged(kind: str, loose: bool, x: Column) -> Column:
    """A candidate with its votes and traits."""
    k, s = ALL_KINDS.index(kind), x["s"]
    n = F.length(_digits(s))
    never = F.lit(False)
    known = {
        "email": _vote(s.rlike(rf"(?i)(?:\.|dot[\])]?\x20?)(?:{ENDINGS})$"), never),
        "ip": _vote(never, s.rlike(r"^(?:0|127|22[4-9]|2[3-9][0-9])\.")),
        "card": _vote(s.rlike("^[3-6]"), never),
        # area and exchange codes do not begin with 0 or 1
        "phone": _vote(s.rlike(r"^\+[1-9]|^\(?[2-9][0-9]{2}\)?[\x20.-]{1,2}[2-9]"), F.lit(True)),
        "secret": _vote(s.rlike(rf"^(?:{TOKENS})|^(?:[0-9a-f]{{32}}|[0-9a-f]{{40}}|[0-9a-f]{{64}})$"), never),
    }[kind]
    sums = {
        "email": _vote(F.length(s) >= 6, F.lit(True)),
        "ip": F.lit(0),
        "card": _vote(F.call_function("luhn_check", _digits(s)), F.lit(True)),
        "phone": _vote(n.between(8, 15), F.lit(True)),
        "secret": _vote(F.size(F.array_distinct(F.split(F.substring(s, 1, 200), ""))) >= 8, F.lit(True)),
    }[kind]
    no = NO_SECRET if kind == "secret" else AGAINST
    context = _vote(x["before"].rlike(rf"\b(?:{CUES[kind]})\b[^\n]{{0,16}}$"), x["before"].rlike(rf"\b(?:{no})\b[^\n]{{0,8}}$"))
    beside = r"[\p{L}\p{N}_/]" if kind == "secret" else r"[\p{L}\p{N}_=/]"
    boundary = _vote(~x["left"].rlike(beside) & ~x["right"].rlike(r"[\p{L}\p{N}_=/]"), F.lit(True))
    pattern = F.lit(0 if loose else 1)
    traits = [s.rlike(r"[\x20()\[\]-]"), F.length(s) > 20, x["left"] == "\n"]
    named = [v.cast("int").alias(n) for v, n in zip([pattern, known, context, boundary, sums], VOTES)] + [t.cast("int").alias(n) for t, n in zip(traits, TRAITS)]
    return F.struct(F.lit(k).alias("kind"), F.lit(loose).alias("loose"), x["start"].alias("start"), x["stop"].alias("stop"), *named)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and spans per row: array of candidates with kind number, loose, start, stop, votes and traits. Text is read once.

    A loose match that meets a base span is no candidate: it is found already.
    """
    valid = lambda kind: lambda x: _valid(kind, x["s"])
    judged = lambda kind, loose: lambda x: _judged(kind, loose, x)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    for kind, (guard, pattern) in BASE.items():
        rows = rows.withColumn(f"{kind}_0", F.filter(_found(F.col("text"), guard, pattern), valid(kind)))
    rows = rows.withColumn("base", F.concat(*[F.transform(f"{k}_0", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))) for k in BASE]))
    for kind, (guard, pattern) in LOOSE.items():
        rows = rows.withColumn(f"{kind}_1", _apart(_found(F.col("text"), guard, pattern), F.col("base")))
    cols = [F.transform(f"{kind}_{int(loose)}", judged(kind, loose)) for loose, kinds in ((False, BASE), (True, LOOSE)) for kind in kinds]
    return rows.select("doc_id", F.concat(*cols).alias("spans"))


def estimate(patterns: list[dict], rounds: int = 40) -> list[float]:
    """Posterior of each vote pattern by EM of a two-class model with independent labelers, one model per kind.

    patterns: dicts with kind, loose, VOTES and n. A labeler without an opinion says nothing of its candidate. What the labelers are
    thought to be worth beforehand (WORTH) gives the first posteriors, and counts as PRIOR of a kind's candidates in every round: without
    it, labelers that never disagree could not be told from ones that know nothing. Strict and loose candidates have shares of right ones
    of their own, and the labelers' reliabilities in common.
    """
    def odds(p: dict, share: list[float], worth: dict) -> float:
        x = math.log(share[1] / share[0])
        for v in VOTES:
            if p[v]:
                a, b = (worth[v][c] if p[v] > 0 else 1 - worth[v][c] for c in (0, 1))
                x += math.log(a / b)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))

    post = [odds(p, [0.5, 0.5], WORTH) for p in patterns]
    for kind in {p["kind"] for p in patterns}:
        own = [i for i, p in enumerate(patterns) if p["kind"] == kind]
        weight = max(4.0, PRIOR * sum(patterns[i]["n"] for i in own))
        for _ in range(rounds):
            mass = {(c, loose): 1.0 for c in (0, 1) for loose in (False, True)}
            votes = {v: [[weight * WORTH[v][c], weight] for c in (0, 1)] for v in VOTES}
            for i in own:
                p = patterns[i]
                # first the right ones, as in WORTH
                for c, q in ((0, post[i]), (1, 1 - post[i])):
                    mass[1 - c, p["loose"]] += q * p["n"]
                    for v in VOTES:
                        if p[v]:
                            votes[v][c][0] += q * p["n"] * (p[v] > 0)
                            votes[v][c][1] += q * p["n"]
            worth = {v: [min(0.999, max(0.001, a / n)) for a, n in votes[v]] for v in VOTES}
            for i in own:
                post[i] = odds(patterns[i], [mass[0, patterns[i]["loose"]], mass[1, patterns[i]["loose"]]], worth)
    return post


#: Features of the span classifier; it does not see which pattern proposed a span, as loose ones alone are to be judged.
FEATURES = [*[f"{k}_kind" for k in ALL_KINDS], *VOTES[1:], *TRAITS]


def _features(p: dict) -> list[float]:
    return [*[float(p["kind"] == k) for k in range(len(ALL_KINDS))], *[float(p[v]) for v in VOTES[1:]], *[float(p[t]) for t in TRAITS]]


def train(patterns: list[dict], post: list[float], steps: int = 400, rate: float = 0.5, decay: float = 1e-3) -> list[float]:
    """Weights of a logistic model of the posteriors, by gradient descent over patterns weighted by the root of their counts."""
    rows = [(_features(p), q, math.sqrt(p["n"])) for p, q in zip(patterns, post)]
    whole = sum(w for _, _, w in rows) or 1.0
    weights = [0.0] * len(FEATURES)
    for _ in range(steps):
        slope = [decay * w for w in weights]
        for x, q, w in rows:
            miss = (1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, x)))) - q) * w / whole
            for j, v in enumerate(x):
                slope[j] += miss * v
        weights = [a - rate * b for a, b in zip(weights, slope)]
    return weights


def probability(weights: list[float], p: dict) -> float:
    return 1 / (1 + math.exp(-sum(a * b for a, b in zip(weights, _features(p)))))


def _seconded(p: dict) -> bool:
    """Whether a labeler that knows something of the kind votes for a candidate, and the context not against it: others are never added,
    whatever their kind's share of right ones. Boundaries alone, and sums that most strings pass, are not enough."""
    return p["context"] >= 0 and (p["gazetteer"] > 0 or p["context"] > 0 or p["kind"] == KINDS.index("card") and p["arithmetic"] > 0)


def add_at(patterns: list[dict], post: list[float], weights: list[float]) -> float:
    """The least probability from which on loose candidates are right to PRECISION, by their posteriors, none of them more likely wrong than
    right; 2 if there is none."""
    loose = sorted(((probability(weights, p), q, p["n"]) for p, q in zip(patterns, post) if p["loose"] and _seconded(p)), reverse=True)
    at, right, every = 2.0, 0.0, 0
    for i, (x, q, n) in enumerate(loose):
        if q < 0.5:
            break
        right, every = right + q * n, every + n
        # candidates of one probability go in together
        if right >= PRECISION * every and (i + 1 == len(loose) or loose[i + 1][0] < x):
            at = x
    return at


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base, spans and secrets per row of docs(doc_id, text): arrays of struct(kind number, start, stop), by kind and start.

    base: the strict patterns' spans. spans: these and all added ones, of the same kinds and of kind 4. secrets: those of kind 4 alone. Null and empty texts have
    none. Repeated rows are rows of their own; ids may be null. An empty table gives an empty result; other columns are not looked at. A
    loose candidate, which meets no base span, is added if a labeler votes for it, its probability is what add_at() says, and it meets no
    added span of an earlier kind.
    """
    found = written(candidates(docs), f"{work_dir(docs.sparkSession)}/spans")
    keys = ["kind", "loose", *VOTES, *TRAITS]
    patterns = [r.asDict() for r in found.select(F.inline("spans")).groupBy(*keys).agg(F.count("*").alias("n")).orderBy(*keys).collect()]
    post = estimate(patterns)
    weights = train(patterns, post)
    least = add_at(patterns, post, weights) - 1e-9

    def likelihood(x: Column) -> Column:
        values = [*[(x["kind"] == k).cast("int") for k in range(len(ALL_KINDS))], *[x[v] for v in VOTES[1:]], *[x[t] for t in TRAITS]]
        return F.lit(1.0) / (F.exp(-reduce(lambda a, b: a + b, [F.lit(w) * v for w, v in zip(weights, values)])) + 1)

    place = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["stop"].alias("stop"))
    seconded = lambda x: (x["context"] >= 0) & ((x["gazetteer"] > 0) | (x["context"] > 0) | ((x["kind"] == KINDS.index("card")) & (x["arithmetic"] > 0)))
    rows = found.select("doc_id", F.filter("spans", lambda x: ~x["loose"]).alias("b"), F.filter("spans", lambda x: x["loose"] & seconded(x) & (likelihood(x) >= least)).alias("l"))
    rows = rows.withColumn("l", _apart(F.col("l"), F.col("l"), lambda x, y: y["kind"] < x["kind"]))
    base, added = F.transform("b", place), F.transform("l", place)
    return rows.select("doc_id", F.array_sort(base).alias("base"), F.array_sort(F.concat(base, added)).alias("spans"), F.array_sort(F.filter(added, lambda x: x["kind"] >= len(KINDS))).alias("secrets"))


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in ALL_KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "<{}>") -> DataFrame:
    """docs, with all its columns and each personal span and secret of the text replaced by its kind's mark.

    Spans come from the text itself, not by an id: repeated rows and ids are as good as others. Null and empty texts stay as they are. Where
    spans of two kinds meet, the one that begins first is marked, and the rest of the other goes as well.
    """
    path = work_dir(docs.sparkSession)
    texts = docs.where("text is not null").select(F.xxhash64("text").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = find_personal_data(texts.groupBy("doc_id").agg(F.first("text").alias("text")))
    spans = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["kind"].alias("kind"))))
    found = written(found.select(F.col("doc_id").alias("__rl_key"), spans.alias("__rl_spans")).where("size(__rl_spans) > 0"), f"{path}/found")
    names = F.array(*[F.lit(mark.format(k)) for k in ALL_KINDS])
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    # pieces are joined once; each is cut from the text where it stands
    step = lambda acc, x: F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.element_at(names, x["kind"] + 1)))).otherwise(acc["out"]).alias("out"))
    done = F.aggregate("__rl_spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return docs.join(found.hint("merge"), F.xxhash64(docs["text"]) == F.col("__rl_key"), "left").withColumn("text", F.when(F.col("__rl_spans").isNull(), text).otherwise(done)).select(*docs.columns)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    many = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    counts = [many(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    n = F.size("spans").cast("long")
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), F.size("secrets").cast("long").alias("n_secret"), digest(F.col("secrets")).alias("secrets"), n.alias("n_found"), (n > 0).alias("found"))
