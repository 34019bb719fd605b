"""English stemming after Porter (1980) and its revision, Porter2, over a table's distinct words."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words whose stems a process keeps as long as it lives, of some 300 bytes each: workers go from task to task, and a vocabulary has no bound.
KEPT = 20_000

_V = "aeiouy"
# Words that Porter2 takes as they are, or stems by hand.
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in "sky news howe atlas cosmos bias andes".split()}
_AFTER_1A = set("inning outing canning herring earring proceed exceed succeed".split())
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "fulli": "ful", "lessli": "less"}
_STEP3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


_BEHIND = re.compile(rf"[{_V}][^{_V}]").search
_SHORT, _TWO = re.compile(rf"[^{_V}][{_V}][^{_V}wxY]$").search, re.compile(rf"[{_V}][^{_V}]").fullmatch
_VOWEL, _VOWEL_BEFORE, _Y_AFTER = re.compile(f"[{_V}]").search, re.compile(rf"[{_V}].").search, re.compile(rf"([{_V}])y").sub
_LAST_Y = re.compile(rf"(?<=.[^{_V}])[yY]$").sub
_STEPS = [("eed", "eedly", "ed", "edly", "ing", "ingly"), (*_STEP2, "ogi", "li"), (*_STEP3, "ative"), (*_STEP4, "ion")]


def _after(w: str, k: int) -> int:
    m = _BEHIND(w, k)
    return m.end() if m else len(w)


def _regions(w: str) -> tuple[int, int]:
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None) if w.startswith(("gener", "commun", "arsen")) else _after(w, 0)
    return r1, _after(w, r1)


def _short_syllable(w: str) -> bool:
    """Ends in a short syllable."""
    return bool(_SHORT(w) or _TWO(w))


def _longest(w: str, endings: tuple) -> str:
    return max((e for e in endings if w.endswith(e)), key=len) if w.endswith(endings) else ""


@lru_cache(maxsize=KEPT)
def porter2(w: str) -> str:
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = w.lstrip("'")
    # a y after a y that has become Y is a vowel again
    if "y" in w:
        w = _Y_AFTER(r"\1Y", "Y" + w[1:] if w[0] == "y" else w)
    r1, r2 = _regions(w)
    if "'" in w:
        w = re.sub("'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and _VOWEL_BEFORE(w[:-1]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    if e := _longest(w, _STEPS[0]):
        if e in ("eed", "eedly"):
            w = w[: -len(e)] + "ee" if len(w) - len(e) >= r1 else w
        elif _VOWEL(w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                w = w[:-1]
            elif r1 >= len(w) and _short_syllable(w):
                w += "e"
    w = _LAST_Y("i", w) if w[-1] in "yY" else w
    if e := _longest(w, _STEPS[1]):
        if len(w) - len(e) >= r1:
            stem = w[: -len(e)]
            if e == "ogi":
                w = stem + "og" if stem.endswith("l") else w
            elif e == "li":
                w = stem if stem and stem[-1] in "cdeghkmnrt" else w
            else:
                w = stem + _STEP2[e]
    if e := _longest(w, _STEPS[2]):
        if e == "ative":
            w = w[:-5] if len(w) - 5 >= r2 else w
        elif len(w) - len(e) >= r1:
            w = w[: -len(e)] + _STEP3[e]
    if e := _longest(w, _STEPS[3]):
        if len(w) - len(e) >= r2 and (e != "ion" or w[:-3].endswith(("s", "t"))):
            w = w[: -len(e)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_syllable(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


_P2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_P3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_P4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    """v for vowels, c for consonants; y is a vowel after a consonant."""
    out = ""
    for k, c in enumerate(w):
        out += "v" if c in "aeiou" or c == "y" and k and out[-1] == "c" else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _cvc(w: str) -> bool:
    return _shape(w)[-3:] == "cvc" and w[-1] not in "wxy"


@lru_cache(maxsize=KEPT)
def porter(w: str) -> str:
    if len(w) <= 2:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        e = _longest(w, ("ed", "ing"))
        if e and "v" in _shape(w[: -len(e)]):
            w = w[: -len(e)]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
                w = w[:-1]
            elif _measure(w) == 1 and _cvc(w):
                w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (_P2, _P3):
        e = _longest(w, tuple(table))
        if e and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + table[e]
    e = _longest(w, (*_P4, "ion"))
    if e and _measure(w[: -len(e)]) > 1 and (e != "ion" or w[:-3].endswith(("s", "t"))):
        w = w[: -len(e)]
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _cvc(w[:-1])):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


STEMMERS = {"snowball": porter2, "porter": porter}
#: The same without a memory, for callers that have their own.
PLAIN = {name: f.__wrapped__ for name, f in STEMMERS.items()}


def stem(col: Column, kind: str = "snowball") -> Column:
    """A column of words, stemmed in Arrow batches."""
    one = STEMMERS[kind]

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(one, na_action="ignore")

    return stems(col)


def stem_arrays(col: Column, kind: str = "snowball", depth: int = 1) -> Column:
    """Arrays of words (of `depth` levels), stemmed in Arrow batches: of each batch, every distinct word once. Nothing is shuffled."""
    if kind == "none":
        return col
    one = STEMMERS[kind]

    def stems(lists):
        import pyarrow as pa

        def level(x):
            if pa.types.is_list(x.type):
                # a slice's offsets do not begin at 0
                offsets = pa.compute.subtract(x.offsets, x.offsets[0])
                return pa.ListArray.from_arrays(offsets, level(x.flatten()), mask=x.is_null() if x.null_count else None)
            words = x.dictionary_encode()
            return pa.array([one(w) for w in words.dictionary.to_pylist()], pa.string()).take(words.indices)

        return level(lists)

    return F.arrow_udf(stems, "array<" * depth + "string" + ">" * depth)(col)


def stem_tokens(tokens: DataFrame, kind: str = "snowball", column: str = "term") -> DataFrame:
    """A table with a row per token (or term): each distinct word is stemmed once, and joined back."""
    if kind == "none":
        return tokens
    words = tokens.select(F.col(column).alias("__w")).distinct()
    return tokens.join(words.select("__w", stem(F.col("__w"), kind).alias("__s")), F.col(column) == F.col("__w")).withColumn(column, F.col("__s")).drop("__w", "__s")
