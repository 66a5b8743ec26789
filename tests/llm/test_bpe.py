"""Byte-level BPE against the library on whole texts, and exact round trips."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireloom.llm import bpe, queries

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TEXT = st.text(st.one_of(st.sampled_from("ab Zz09'\n\t\r .,!?st 　é漢🙂́\x1c"), st.characters(exclude_categories=["Cs"])), max_size=200)


def whole(text):
    return bpe.load_encoding(PATH, PATTERN).encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(1, 40))
def test_pieces_give_what_the_whole_text_gives(text, limit):
    encoding = bpe.load_encoding(PATH, PATTERN)
    assert "".join(bpe.safe_pieces(text, limit)) == text
    ids = bpe.encode_text(encoding, text, limit)
    assert ids.tolist() == whole(text)
    assert encoding.decode_bytes(ids.tolist()) == text.encode()


def test_query_against_the_library(spark, data):
    got = {r["doc_id"]: r for r in queries.QUERIES["op1_byte_bpe"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids, row = np.array(whole(d["text"] or ""), "<u4"), got[d["doc_id"]]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()


def test_edges(spark):
    long = "Wörter und 漢字 <|endoftext|> " * 20_000
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x"), (None, "n", None), (4, long, "x"), (5, "a" * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Decoded string")
    out = bpe.unpack(bpe.decode(bpe.encode(df, PATH, PATTERN), PATH, PATTERN))
    assert [c.lower() for c in out.columns] == ["doc_id", "text", "ids", "n_tokens", "decoded", "token_ids"]
    got = out.collect()
    assert len(got) == len(rows)
    both = bpe.encode_and_decode(df, PATH, PATTERN)
    assert sorted(both.columns) == ["decoded", "doc_id", "ids", "n_tokens", "text"]
    assert sorted(map(str, both.select("doc_id", "text", "ids", "n_tokens", "decoded").collect())) == sorted(map(str, out.select("doc_id", "text", "ids", "n_tokens", "decoded").collect()))
    for r in got:
        assert bytes(r["decoded"]).decode() == (r["text"] or "")
        assert r["token_ids"] == whole(r["text"] or "") and r["n_tokens"] == len(r["token_ids"])
    assert bpe.encode(df.limit(0), PATH, PATTERN).count() == 0
    assert bpe.encode(df, PATH, PATTERN, keep_text=False).columns == ["doc_id", "Decoded", "ids", "n_tokens"]


def test_ids_that_are_not_text(spark):
    """Decoding gives raw bytes, also of ids that cut a character in two."""
    encoding = bpe.load_encoding(PATH, PATTERN)
    one = encoding.encode_single_token(b"\xe6")
    df = spark.createDataFrame([(1, bytearray(np.array([one], "<u4").tobytes())), (2, None)], "doc_id long, ids binary")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bpe.decode(df, PATH, PATTERN).collect()}
    assert got == {1: b"\xe6", 2: b""}


@pytest.mark.parametrize("text", ["!\n\nx", "a1b2", "it's 5's", "x  y", "tail   ", "\n \n a"])
def test_known_boundaries(text):
    assert bpe.encode_text(bpe.load_encoding(PATH, PATTERN), text, 1).tolist() == whole(text)
