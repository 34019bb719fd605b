"""Text cleaning and tokenizing as column expressions, which stay inside the JVM; words of a large vocabulary are marked by an automaton in Arrow batches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field, fields
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rankloom.functions import stopwords
from rankloom.functions.stem import stem_arrays

# Patterns of what is cleaned away. White space and digits are those of Unicode.
SPACE = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"
MATH = r"\$[^$]*\$"
LATEX = r"\\[a-zA-Z]+"
URL = rf"https?://[^{SPACE}]+|www\.[^{SPACE}]+"
CITATION = rf"\[[{SPACE}]*\p{{Nd}}+(?:[{SPACE}]*[,–-][{SPACE}]*\p{{Nd}}+)*[{SPACE}]*\]"
EMPTY_BRACKETS = rf"\([{SPACE}]*\)|\[[{SPACE}]*\]"
SPACE_BEFORE_MARK = rf"[{SPACE}]+([.,;:!?)\]])"
TOKEN = r"[\p{L}\p{N}]+"
TOKEN_UNDERSCORE = r"[\p{L}\p{N}_]+"
WORD = rf"[^{SPACE}]+"
SENTENCE_END = r"(?<=[.!?])[\s\x0b]+"


@dataclass(frozen=True)
class Cleaning:
    remove_math: bool = True
    remove_urls: bool = True
    remove_citations: bool = True

    @classmethod
    def of(cls, d: dict) -> Cleaning:
        return cls(**known_keys(cls, d))


@dataclass(frozen=True)
class Tokenizing:
    lowercase: bool = True
    split_underscores: bool = True
    min_token_length: int = 2
    drop_numeric: bool = True
    stopwords: tuple = field(default_factory=lambda: tuple(stopwords.build()))
    stemming: str = "snowball"

    def __post_init__(self):
        if not isinstance(self.min_token_length, int) or self.min_token_length < 1:
            raise ValueError("min_token_length must be a positive number")
        if self.stemming not in ("none", "porter", "snowball"):
            raise ValueError(f"unknown stemmer {self.stemming!r}")

    @classmethod
    def of(cls, d: dict) -> Tokenizing:
        d = dict(known_keys(cls, d))
        if "stopwords" not in d:
            raise ValueError("the stopwords section is missing")
        s = d["stopwords"]
        d["stopwords"] = tuple(stopwords.build(s.get("source", "english"), s.get("extra"), s.get("keep"), s.get("custom")))
        return cls(**d)


BASELINE = Tokenizing(split_underscores=False, min_token_length=1, drop_numeric=False, stopwords=tuple(stopwords.build(keep=("not", "no"))), stemming="none")
#: The usual settings without the last step.
UNSTEMMED = Tokenizing(stemming="none")


def known_keys(cls, d: dict) -> dict:
    """d, or an error that names the keys that cls does not know."""
    odd = sorted(set(d) - {f.name for f in fields(cls)})
    if odd:
        raise ValueError(f"unknown keys: {', '.join(odd)}")
    return d


def known_sections(d: dict, names: tuple) -> dict:
    odd = sorted(set(d) - set(names))
    if odd:
        raise ValueError(f"unknown sections: {', '.join(map(str, odd))}")
    return d


def clean_math(t: Column) -> Column:
    """Inline math goes if the dollar signs pair up; commands always go. Each match becomes one space."""
    paired = F.length(F.regexp_replace(t, r"[^$]", "")) % 2 == 0
    return F.regexp_replace(F.when(paired, F.regexp_replace(t, MATH, " ")).otherwise(t), LATEX, " ")


def clean_urls(t: Column) -> Column:
    return F.regexp_replace(t, URL, " ")


def clean_citations(t: Column) -> Column:
    return F.regexp_replace(t, CITATION, " ")


def clean_text(t: Column, cfg: Cleaning = Cleaning()) -> Column:
    for on, step in ((cfg.remove_math, clean_math), (cfg.remove_urls, clean_urls), (cfg.remove_citations, clean_citations)):
        t = step(t) if on else t
    return t


def clean_for_encoder(t: Column, cfg: Cleaning = Cleaning()) -> Column:
    """clean_text; then empty brackets and each white-space character become a space, space before marks goes, ends are trimmed."""
    t = F.regexp_replace(clean_text(t, cfg), EMPTY_BRACKETS, " ")
    return F.btrim(F.regexp_replace(F.regexp_replace(t, f"[{SPACE}]", " "), SPACE_BEFORE_MARK, "$1"))


def words(t: Column, cfg: Tokenizing = Tokenizing(), cleaning: Cleaning | None = None) -> Column:
    """Tokens in order before stemming, repeats kept; null gives no tokens. All of it runs inside the JVM."""
    t = F.coalesce(t, F.lit(""))
    t = clean_text(t, cleaning) if cleaning else t
    t = F.lower(t) if cfg.lowercase else t
    tokens = F.regexp_extract_all(t, F.lit(TOKEN if cfg.split_underscores else TOKEN_UNDERSCORE), F.lit(0))
    out = cfg.stopwords

    def kept(x: Column) -> Column:
        ok = F.length(x) >= cfg.min_token_length
        if cfg.drop_numeric:
            ok = ok & ~x.rlike(r"^\p{Nd}+$")
        return ok & ~x.isin(*out) if out else ok

    return F.filter(tokens, kept)


def tokenize(t: Column, cfg: Tokenizing = Tokenizing(), cleaning: Cleaning | None = None) -> Column:
    """Tokens in order, repeats kept, stemmed as cfg says; null gives no tokens."""
    return stem_arrays(words(t, cfg, cleaning), cfg.stemming)


def count_words(t: Column) -> Column:
    return F.coalesce(F.regexp_count(t, F.lit(WORD)), F.lit(0)).cast("long")


def normalize_space(t: Column) -> Column:
    return F.btrim(F.regexp_replace(t, f"[{SPACE}]+", " "))


def sentences(t: Column) -> Column:
    return F.split(t, SENTENCE_END)


def truncate(t: Column, n: int) -> Column:
    """The text, or its first n characters back to the last space, with three dots."""
    return F.when(F.length(t) <= n, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, n), " [^ ]*$", ""), F.lit("...")))


def title_and_text(title: Column, text: Column) -> Column:
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "), text)).otherwise(text)


def title_and_abstract(title: Column, abstract: Column) -> Column:
    return F.btrim(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(abstract, F.lit(""))))


def paper_year(paper_id: Column) -> Column:
    return F.lit(2000) + F.substring(paper_id, 1, 2).cast("int")


def matcher(words: list[str]) -> str:
    """A pattern of whole words, longest first, without regard to case; '' for no words."""
    words = sorted({w for w in words if w.strip()}, key=lambda w: (-len(w), w))
    escaped = ["".join(c if c.isalnum() or c == " " else "\\" + c for c in w) for w in words]
    return rf"(?iu)(?<![\p{{L}}\p{{N}}])({'|'.join(escaped)})(?![\p{{L}}\p{{N}}])" if words else ""


#: Words up to which a pattern is as good as an automaton.
FEW_WORDS = 40


def highlight(t: Column, words: list[str], before: str = "<mark>", after: str = "</mark>", few: int = FEW_WORDS) -> Column:
    """Whole words of a text marked, without regard to case: at each place the longest one.

    A few words are a pattern. More are an automaton, which goes over a text once however many words there are.
    """
    words = sorted({w for w in words if w.strip()})
    if len(words) > few:
        return marked(words, before, after)(t)
    pattern = matcher(words)
    return F.regexp_replace(t, pattern, f"{before}$1{after}") if pattern else t


def fold(t: str) -> str:
    """A text without case, character by character, so that places stay."""
    return "".join(map(_folded, t)) if not t.isascii() else t.lower()


@lru_cache(maxsize=100_000)
def _folded(c: str) -> str:
    up = c.upper()
    low = (up if len(up) == 1 else c).lower()
    return low if len(low) == 1 else c


class Marker:
    """An Aho-Corasick automaton of words. Each task makes it once."""

    def __init__(self, words: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        for w in words:
            self.automaton.add_word(fold(w))
        self.automaton.make_automaton()

    def spans(self, t: str) -> list[tuple[int, int]]:
        """(start, end) of the words of a text, from the left, at each place the longest, without overlaps; none begins or ends inside of a run of letters and numbers."""
        longest: dict[int, int] = {}
        for last, n in self.automaton.iter(fold(t)):
            start, end = last + 1 - n, last + 1
            if end > longest.get(start, 0) and not (start and _inside(t[start - 1])) and not (end < len(t) and _inside(t[end])):
                longest[start] = end
        out, at = [], 0
        for start in sorted(longest):
            if start >= at:
                at = longest[start]
                out.append((start, at))
        return out

    def mark(self, t: str, before: str, after: str) -> str:
        out, at = [], 0
        for start, end in self.spans(t):
            out += [t[at:start], before, t[start:end], after]
            at = end
        return "".join([*out, t[at:]])


@lru_cache(maxsize=100_000)
def _inside(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def marked(words: list[str], before: str, after: str):
    """highlight() of a column by a Marker."""

    @F.pandas_udf("string")
    def mark(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        marker = Marker(words)
        for texts in columns:
            yield texts.map(lambda t: marker.mark(t, before, after), na_action="ignore")

    return mark
