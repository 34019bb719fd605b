import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from rankloom.llm import token_counts as T


def library():
    """The sentencepiece library with the same pieces and scores as a unigram model."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    model.ParseFromString(open(T.default_model(), "rb").read())
    model.trainer_spec.model_type = 1
    for p in model.pieces:
        if p.piece in SCORES:
            p.score, p.type = SCORES[p.piece], 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


SCORES = T.piece_scores(T.default_model())
LIBRARY, COUNTER = library(), T.Counter(SCORES)


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcdeistn ABé日.,\n\t1ß "), max_size=60))
def test_equals_library(text):
    assert COUNTER.counts([text])[0][1] == len(LIBRARY.encode(text))


def test_query_equals_library(spark, sf):
    got = {r["doc_id"]: r["n_tokens"] for r in T.op2(spark, sf).collect()}
    assert got == {r["doc_id"]: len(LIBRARY.encode(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_prefixes_are_shared():
    one, many = T.Counter(SCORES), T.Counter(SCORES)
    words = [" inter", " international", " internationally", " internet"]
    one.learn(words)
    for w in words:
        many.learn([w])
    assert one.known == many.known and one.runs == len(" internationally") + len("et") < many.runs


def test_odd_rows(odd, none):
    rows = T.count_tokens(odd).collect()
    assert len(rows) == odd.count() and sum(r["n_tokens"] for r in rows) == sum(len(LIBRARY.encode(r["text"] or "")) for r in odd.collect())
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (2, 3)} == {0}
    assert T.count_tokens(none).count() == 0


def test_long_pretokens_are_not_kept(monkeypatch):
    monkeypatch.setattr(T, "STEP", 1000)
    counter = T.Counter(T.piece_scores(T.default_model()))
    texts = ["x" * 5000, "the cat", None, "", "y" * 900 + " the", "a" * 300 + " " + "b" * 300] * 3
    plain = T.Counter(T.piece_scores(T.default_model()))
    monkeypatch.setattr(T, "STEP", 1 << 30)
    expected = plain.counts(texts)
    monkeypatch.setattr(T, "STEP", 1000)
    assert counter.counts(texts) == expected and max(map(len, counter.known)) <= T.KEPT_LENGTH
