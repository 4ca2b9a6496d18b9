"""The encoding of a corpus equals the encoding of each whole text."""

import numpy as np
import pytest
from causeway.llm import encode
from causeway.llm.encode import _encoder, certain_starts, encode_corpus
from causeway.llm.rolling import code_points, window_hashes
from conftest import DATA
from hypothesis import given, settings
from hypothesis import strategies as st

PATH = f"{encode.TOKENIZERS}/{encode.VOCABULARY}"
SCHEMA = "doc_id long, text string, ids string"


def encoded(spark, texts):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    return {r["doc_id"]: r["ids"] for r in encode_corpus(df).collect()}


def test_corpus(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {r["doc_id"]: _encoder(PATH).encode_ordinary(r["text"] or "") for r in docs.select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["ids"] for r in encode_corpus(docs).collect()} == want


def test_odd_texts(spark):
    shared = "We cleared the spool and drain time settled near the limit. " * 40
    texts = [None, "", " ", "\n\n \n", "a", "<|endoftext|>", shared, "x" + shared, shared[::-1], "a" * 20_000, " " * 5_000, "校验失败" * 3_000, "it's they'll we'd 'tis 'S" * 300, "​  x" * 500, "👩‍👩‍👧 é́" * 400, "1234567890" * 900, "'s" * 2_000, "\x1c\x1d\x85 \t\v\f" * 300, shared]
    got = encoded(spark, texts)
    for i, t in enumerate(texts):
        assert got[i] == _encoder(PATH).encode_ordinary(t or ""), i


def test_chunks_are_encoded_once(monkeypatch):
    """A passage of many texts costs one encoding in a task, also when what is kept is bounded."""
    import pyarrow as pa

    made, part = [], "We cleared the spool and drain time settled near the limit, as noted on day four. " * 60
    own = encode.ChunkIds.__init__
    monkeypatch.setattr(encode.ChunkIds, "__init__", lambda self, e: (made.append(self), own(self, e))[1])
    texts = [f"{i} {part} {i}" for i in range(50)]
    for kept in (encode._KEPT_CHARS, 6_000):
        monkeypatch.setattr(encode, "_KEPT_CHARS", kept)
        batch = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(texts)], names=["doc_id", "text"])
        got = [ids for b in encode._encode_texts(PATH)(iter([batch])) for ids in b.column(1).to_pylist()]
        assert got == [_encoder(PATH).encode_ordinary(t) for t in texts]
    assert made[0].encoded < 150 and len(made) == 2


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "same text here", None), (1, "same text here", None), (2, "b", None), (2, "c", None), (None, "b", None)], SCHEMA)
    rows = [(r["doc_id"], tuple(r["ids"])) for r in encode_corpus(df).collect()]
    e = _encoder(PATH).encode_ordinary
    assert sorted(rows, key=str) == sorted([(1, tuple(e("same text here"))), (2, tuple(e("b"))), (2, tuple(e("c"))), (None, tuple(e("b")))], key=str)
    assert encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'sd 1.\n\t校，é Z"), max_size=60))
def test_certain_starts_split_exactly(text):
    e = _encoder(PATH).encode_ordinary
    parts = [text[a:b] for a, b in zip([0, *certain_starts(code_points(text))], [*certain_starts(code_points(text)), len(text)])]
    assert [i for p in parts for i in e(p)] == e(text)


@pytest.mark.parametrize("k", [1, 5, 16, 80])
def test_window_hashes(k):
    pts = code_points("abcdefghi" * 30)
    (h,) = window_hashes(pts, k)
    for i in range(0, len(h) - 9, 7):
        assert (h[i] == h[i + 9]) and (k % 9 == 0 or len(set(np.unique(h[:9]))) == 9)
