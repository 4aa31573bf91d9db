from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer, models, pre_tokenizers

from treeloom.llm.token_counts import PieceCounter, Vocabulary, count_tokens, load_vocabulary, op2

REAL = load_vocabulary()
COUNTER = PieceCounter(REAL)
TIES = Vocabulary({"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -2.0, "▁a": -2.0, "ba": -2.0, "aab": -3.0, "bb": -1.0, "abba": -3.0}, False)


def tokenizer(v, split=True):
    low = min(v.pieces.values())
    extra = [(f"<0x{i:02X}>", low) for i in range(256)] if v.byte_fallback else []
    out = Tokenizer(models.Unigram([("<unk>", low), *extra, *v.pieces.items()], 0, v.byte_fallback))
    out.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=split)
    return out


# The given vocabulary has pieces of several marks, so texts are not cut for its tokenizer.
FULL, SMALL = tokenizer(REAL, split=False), tokenizer(TIES)
MARKS = Vocabulary(TIES.pieces | {"▁▁": -1.5, "▁▁▁▁": -2.0, "▁▁a": -2.25}, False)
ACROSS = Vocabulary(TIES.pieces | {"a▁b": -1.25}, False)


@given(st.text(st.sampled_from("ab ▁\néß日🦊xyz.,0"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_counts_are_the_tokenizers(text):
    assert COUNTER.text(text)[0] == len(FULL.encode(text, add_special_tokens=False).tokens)


@given(st.text(st.sampled_from("ab c"), max_size=14))
@settings(max_examples=300, deadline=None)
def test_ties_and_unknown_runs(text):
    assert PieceCounter(TIES).text(text)[0] == len(SMALL.encode(text, add_special_tokens=False).tokens)


@given(st.text(st.sampled_from("ab c"), max_size=14))
@settings(max_examples=300, deadline=None)
def test_pieces_across_marks(text):
    for v in (MARKS, ACROSS):
        assert PieceCounter(v).text(text)[0] == len(tokenizer(v, split=False).encode(text, add_special_tokens=False).tokens)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    out = op2(docs).collect()
    assert len(out) == len(texts)
    for r in out:
        assert r["n_tokens"] == len(FULL.encode(texts[r["doc_id"]], add_special_tokens=False).tokens)
        assert r["score"] < 0


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "a " * 200_000, 5), (None, "b", 5), (4, "x", 5), (4, "x", 5)], "doc_id long, text string, n_tokens long")
    out = sorted((r["doc_id"] or 0, r["n_tokens"], r["n_chars"]) for r in op2(df).collect())
    assert out == [(0, 1, 1), (1, 0, 0), (2, 0, 0), (3, 200_001, 400_000), (4, 1, 1), (4, 1, 1)]
    assert op2(df.where("false")).collect() == []
    assert [r["n_tokens"] for r in count_tokens(df.where("doc_id = 4"), Vocabulary({}, False)).collect()] == [1, 1]
