"""Counts of the compiled transducer against the tokenizer library."""

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quireloom.llm import queries, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(st.one_of(st.sampled_from("ab Zz09'\n\t\r .,!?stmdlvre 　é漢🙂́\x1c½"), st.characters(exclude_categories=["Cs"])), max_size=300)


def library(text):
    return len(token_counts.compiled(PATH)[0].tokenizer.encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXT, max_size=6), st.integers(1, 40))
def test_counts(texts, chunk):
    transducer, splitter = token_counts.compiled(PATH)
    assert token_counts.count_tokens(texts, transducer, splitter, chunk).tolist() == [library(t) for t in texts]


@pytest.mark.parametrize(
    "text",
    ["don't we'll they've I'm you're he'd it's", "x''s 'll 'l", "a" * 5_000, "=" * 3_000, " " * 700 + "x", "1234567890" * 300, "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "ﬁ漢字かな" * 200, "' 's", "'s", "''", "a'", "a'l"],
)
def test_hard_texts(text):
    transducer, splitter = token_counts.compiled(PATH)
    assert token_counts.count_tokens([text], transducer, splitter).tolist() == [library(text)]


def test_a_full_table_keeps_what_is_in_use(monkeypatch):
    """In the midst of a run too: the table stays within its bound, and counts stay right."""
    import random

    r = random.Random(1)
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)
    monkeypatch.setattr(token_counts, "LANES", 16)
    monkeypatch.setattr(token_counts, "MOST_PAIRS", 20)
    transducer, splitter = token_counts.Transducer(PATH), token_counts.compiled(PATH)[1]
    texts = ["some words to fill the table with states", "and quite different letters zyx", "".join(r.choice("abcdefgh") for _ in range(3_000))]
    for chunk in (7, 128):
        assert token_counts.count_tokens(texts, transducer, splitter, chunk).tolist() == [library(t) for t in texts]
    assert len(transducer.states) <= 50 + 16 + 2 and len(transducer.pairs) <= 20


def test_text_without_boundaries(monkeypatch):
    """Maps of open chunks compose: turns of the scan do not follow the length of the text."""
    transducer, splitter = token_counts.compiled(PATH)
    turns = []
    whole = token_counts.Transducer._lockstep
    monkeypatch.setattr(token_counts.Transducer, "_lockstep", lambda self, *a, **k: (turns.append(1), whole(self, *a, **k))[1])
    for text in ("a" * 1_000_000, "abcab" * 100_000, "=" * 500_000):
        turns.clear()
        assert token_counts.count_tokens([text], transducer, splitter).tolist() == [library(text)]
        assert len(turns) < 40


def test_query_against_the_library(spark, data):
    got = {r["doc_id"]: r for r in queries.QUERIES["op2_token_counts"](spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for d in docs:
        text, row = d["text"] or "", got[d["doc_id"]]
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len(text.encode()), n := library(text), n > 512)


def test_edges(spark):
    rows = [(1, None, 7), (2, "", 7), (3, "a b", 7), (3, "a b", 7), (None, "n", None), (4, "long words " * 50_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens int")
    out = token_counts.add_token_counts(df, PATH)
    assert out.columns == ["doc_id", "text", "n_tokens"]
    got = out.collect()
    assert len(got) == len(rows) and all(r["n_tokens"] == library(r["text"] or "") for r in got)
    assert token_counts.add_token_counts(df.limit(0), PATH).count() == 0
