import heapq
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rankloom.llm import huffman as H

TOKENIZER = Tokenizer.from_file(H.default_tokenizer())


def expected(rows):
    """(doc_id, start, n, crc32) by the library, ids ascending."""
    start, out = 0, []
    for d, t in sorted(rows):
        ids = [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 1]
        out.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_query_equals_library(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, H.op6(spark, sf).collect())) == expected(docs)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(st.sampled_from("aB'sdl t<|endofx>19²½ẞÀİΑΣ.,!\x1c\x85 日　-_"), max_size=60))
def test_words_equal_library(text):
    words = H._words(H.default_tokenizer())
    ids = np.frombuffer(words.ids([text])[0], words.kind).tolist()
    assert ids == [*TOKENIZER.encode(text, add_special_tokens=False).ids, 1]


def cost(counts):
    """Bits of an unlimited Huffman code."""
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        total += a
        heapq.heappush(heap, a)
    return total


def test_code_lengths():
    r = random.Random(2)
    for n in (2, 3, 10, 200):
        counts = [r.randrange(0, 1000) for _ in range(n)] + [1]
        free = H.code_lengths(counts, 30)
        assert sum(int(x) * c for x, c in zip(free, counts)) == (cost(counts) if sum(map(bool, counts)) > 1 else 1)
        tight = H.code_lengths(counts, 8)
        assert tight.max() <= 8 and sum(2.0 ** -int(x) for x in tight if x) <= 1
    powers = [2**k for k in range(30)]
    assert H.code_lengths(powers, 6).max() <= 6 and sum(2.0 ** -int(x) for x in H.code_lengths(powers, 6)) == 1
    assert H.code_lengths([0, 5, 0]).tolist() == [0, 1, 0] and H.code_lengths([0]).tolist() == [0]


@pytest.mark.parametrize("n_ids", [1, 2, 50, 5000])
def test_blocks_round_trip(n_ids):
    r = np.random.default_rng(n_ids)
    docs = [r.zipf(1.3, n).clip(1, n_ids) - 1 for n in (1, 700, 1, 256, 257, 3000)]
    code = H.Code(H.code_lengths(np.bincount(np.concatenate(docs), minlength=n_ids)))
    ids, ends = np.concatenate(docs), np.cumsum([len(x) for x in docs])
    data, after, marks, upto = code.encode(ids, ends)
    cut = lambda x, e: [x[a:b] for a, b in zip([0, *e[:-1]], e)]
    block = H.pack([(len(x), m.astype(np.uint32).tobytes(), b) for x, m, b in zip(docs, cut(marks, upto), cut(data, after))])
    back, counts = H.unpack(code, block)
    assert back.tolist() == ids.tolist() and counts.tolist() == [len(x) for x in docs]
    with pytest.raises(ValueError):
        H.unpack(code, b"x" + block)


def test_odd_rows(spark, odd, none, tmp_path):
    rows = sorted(map(tuple, H.round_trip(odd, path=str(tmp_path / "ids")).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == sorted([r["doc_id"] for r in odd.collect()], key=lambda d: (d is not None, d or 0))
    assert [r[1] for r in rows] == [sum(x[2] for x in rows[:k]) for k in range(len(rows))]
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    for d, _, n, crc in rows:
        assert (n, crc) in {e[2:] for t in texts[d] for e in expected([(0, t)])}
    ids = {r["doc_id"]: r["ids"] for r in H.read_ids(spark, str(tmp_path / "ids")).collect()}
    assert ids[6] == [*TOKENIZER.encode("one", add_special_tokens=False).ids, 1]
    assert H.round_trip(none).count() == 0
