"""Text encoders as a pluggable surface: batches of texts in, vectors out, the model loaded once per Python worker.

The box has no learned models. HashEncoder stands in for them: deterministic, of unit length, near for texts that share words.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.text import SPACE


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> list[list[float]]: ...


class _Places(dict):
    """Words to places: of a vector of `size`, the first for words that take 1, then those that add 1. So many words are remembered."""

    def __init__(self, size: int, most: int = 200_000):
        self.size, self.most = size, most

    def __missing__(self, word: str) -> int:
        import hashlib

        if len(self) >= self.most:
            self.clear()
        h = hashlib.md5(word.encode("utf-8", "surrogatepass")).hexdigest()
        self[word] = place = int(h[:7], 16) % self.size + self.size * (int(h[7], 16) & 1)
        return place


class HashEncoder:
    """Each word adds 1 or takes 1 at a place, both by its md5. If the words of a text cancel out, the first alone counts: each text with a word has length 1.
    max_words: words of a text that are read, all if None, as a learned encoder has a limit."""

    def __init__(self, size: int = 64, max_words: int | None = None):
        self.size, self.max_words, self.places = size, max_words, _Places(size)

    def encode(self, texts: list[str]) -> list[list[float]]:
        import numpy as np

        out = []
        for text in texts:
            words = (text or "").lower().split()[: self.max_words]
            n = np.bincount([self.places[w] for w in words], minlength=2 * self.size) if words else np.zeros(2 * self.size)
            v = (n[self.size :] - n[: self.size]).astype(float)
            if words and not v.any():
                v[self.places[words[0]] % self.size] = 1.0 if self.places[words[0]] >= self.size else -1.0
            out.append((v / np.sqrt(v @ v) if words else v).tolist())
        return out


#: Words of a window of a long text, and words from one window's first to the next one's.
WINDOW, STRIDE = 256, 192


def windows(rows: DataFrame, column: str = "text", size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """rows with a row per window of `size` words, numbered from 0 in `window`; the words, space-joined, are the text. A short text is one window.

    Windows overlap by size - stride words, and each word is in one: encoders that read `size` words see all of a text.
    """
    if not 0 < stride <= size:
        raise ValueError("windows must overlap or touch")
    words = F.filter(F.split(F.coalesce(F.col(column), F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
    last = F.greatest(F.ceil((F.size("__w") - size) / stride), F.lit(0)).cast("int")
    each = rows.withColumn("__w", words).withColumn("window", F.explode(F.sequence(F.lit(0), last)))
    return each.withColumn(column, F.array_join(F.slice("__w", F.col("window") * stride + 1, size), " ")).drop("__w")


def encode(rows: DataFrame, make: type | object = HashEncoder, column: str = "text", out: str = "vector", batch: int = 256) -> DataFrame:
    """rows with a vector per text. `make()` gives an encoder; it is called once per task."""

    @F.pandas_udf("array<float>")
    def vectors(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in columns:
            found: list = []
            for k in range(0, len(texts), batch):
                found += model.encode(texts.iloc[k : k + batch].tolist())
            yield pd.Series(found, dtype=object)

    return rows.withColumn(out, vectors(F.coalesce(F.col(column), F.lit(""))))


def logits(rows: DataFrame, make: type | object = HashEncoder, column: str = "text") -> DataFrame:
    """doc_id, term, x, mask: encoder outputs in long form, the input of ranking.max_pool."""
    vectors = encode(rows, make, column)
    return vectors.select("doc_id", F.posexplode("vector").alias("p", "x")).select("doc_id", (F.col("p") + 1).cast("long").alias("term"), F.col("x").cast("double").alias("x"), F.lit(1).alias("mask"))


def window_logits(rows: DataFrame, make: type | object = HashEncoder, column: str = "text", size: int = WINDOW, stride: int = STRIDE) -> DataFrame:
    """logits() of all windows of each text, for ranking.max_pool, which takes the greatest of them."""
    return logits(windows(rows.select("doc_id", column), column, size, stride), make, column)
