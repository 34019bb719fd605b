"""Operator 2, token counts by trie-shared dynamic programming.

The tokens are those of the best segmentation under a unigram model. Pieces never join what a space or a line end parts, so texts are
cut into pre-tokens; a batch's distinct new pre-tokens are walked in sorted order, which is the depth-first order of their trie, and the
forward scores of a prefix that neighbours share are computed once. Terminal counts are kept per worker, up to a bound.

The model is a public piece vocabulary. Its file has merge ranks, no probabilities; by rule, the piece at place k has the log
probability of Zipf's law, -ln((k + 1) H). Characters without a piece cost UNKNOWN below the rarest piece, and count as their bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import table

SPACE = "▁"
UNKNOWN = 10.0
#: Pre-tokens whose counts a worker keeps, and the longest one that is kept; characters of texts that are counted at a time.
KNOWN, KEPT_LENGTH, STEP = 400_000, 64, 8 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def piece_scores(path: str) -> dict[str, float]:
    """Log probabilities of the pieces of a sentencepiece file, by their places under its own scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    usual = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    usual.sort(key=lambda i: (-model.get_score(i), i))
    total = math.log(sum(1 / (k + 1) for k in range(len(usual))))
    return {model.id_to_piece(i): -math.log(k + 1) - total for k, i in enumerate(usual)}


class Counter:
    """Counts tokens of texts; `runs` tells how many forward scores were computed, for tests."""

    def __init__(self, scores: dict[str, float]):
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in scores):
            raise ValueError("a piece reaches over the end of a pre-token")
        self.scores = scores
        # every end of a piece, so that looking back stops early; None where it is no piece itself
        self.ends: dict[str, float | None] = {p[k:]: None for p in scores for k in range(len(p))}
        self.ends.update(scores)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN
        self.known: dict[str, int] = {"": 0}
        self.runs = 0

    def pretokens(self, text: str) -> list[str]:
        """The text has a space put before it; a pre-token is a run of spaces with what follows up to the next, or a line end."""
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            line = line if k else " " + line
            if "  " in line or line.endswith(" "):
                out += _PARTS.findall(line)
            else:
                first, *rest = line.split(" ")
                out.append(first)
                out += [" " + w for w in rest]
        return out

    def learn(self, pretokens) -> None:
        """Terminal counts of pre-tokens that are not known yet."""
        ends, known, last = self.ends, self.known, ""
        best, count = [0.0], [0]
        for raw in sorted(pretokens):
            word = raw.replace(" ", SPACE)
            shared, limit = 0, min(len(last), len(word))
            while shared < limit and last[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], count[shared + 1 :]
            for e in range(shared + 1, len(word) + 1):
                self.runs += 1
                top, n, s = -math.inf, 0, e - 1
                while s >= 0:
                    part = word[s:e]
                    if part not in ends:
                        break
                    score = ends[part]
                    if score is not None and best[s] + score > top:
                        top, n = best[s] + score, count[s] + 1
                    s -= 1
                if word[e - 1] not in self.scores and best[e - 1] + self.unknown > top:
                    top, n = best[e - 1] + self.unknown, count[e - 1] + len(word[e - 1].encode("utf-8", "surrogatepass"))
                best.append(top)
                count.append(n)
            known[raw] = count[-1]
            last = word

    def counts(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(pre-tokens, tokens) of each text; none for null and empty texts. Texts are taken up to STEP characters at a time, or one alone;
        long pre-tokens are forgotten after that, so that what is kept is bounded in bytes as well."""
        out: list[tuple[int, int]] = []
        begin = 0
        while begin < len(texts):
            end, size = begin + 1, len(texts[begin] or "")
            while end < len(texts) and size + len(texts[end] or "") <= STEP:
                size += len(texts[end] or "")
                end += 1
            if len(self.known) > KNOWN:
                self.known = {"": 0}
            split = [self.pretokens(t) if t else [] for t in texts[begin:end]]
            new = {w for words in split for w in words if w not in self.known}
            self.learn(new)
            known = self.known
            out += [(len(words) - words.count(""), sum([known[w] for w in words])) for words in split]
            for w in new:
                if len(w) > KEPT_LENGTH:
                    del known[w]
            begin = end
        return out


_PARTS = re.compile(r" +[^ ]*|[^ ]+")


def count_tokens(docs: DataFrame, model: str | None = None, batch: int = 1000) -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens per row of docs(doc_id, text).

    Null and empty texts have none. Repeated rows are rows of their own; ids may be null. An empty table gives an empty result; other
    columns are not looked at. Nothing is shuffled.
    """
    path = model or default_model()

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        counter = Counter(piece_scores(path))
        for b in batches:
            for k in range(0, b.num_rows, batch):
                texts = b.column(1).slice(k, batch).to_pylist()
                n = counter.counts(texts)
                cols = [pa.array([len(t or "") for t in texts], pa.int64()), pa.array([x for x, _ in n], pa.int64()), pa.array([x for _, x in n], pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(k, batch), *cols], ["doc_id", "n_chars", "n_pretokens", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(counted, f"doc_id {kind}, n_chars long, n_pretokens long, n_tokens long")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
