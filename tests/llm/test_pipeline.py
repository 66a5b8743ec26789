"""The pipeline's stages against brute-force versions, and on awkward rows."""

import random
import re
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from quireloom.llm import bpe, secrets, toxicity
from quireloom.session import read_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows_of(df):
    return df.select(*corpus_pipeline.COLUMNS).collect()


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def near_copies(docs, k=5, similarity=0.8):
    """Component (least id) of each document by the sets of its shingles, all pairs compared."""
    sets = []
    for _, t in docs:
        w = WORD.findall(lower(t or ""))
        grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
        sets.append(np.unique(np.array([xxhash.xxh64_intdigest(g.encode()) for g in grams], np.uint64)))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if len(a) and len(b) and min(len(a), len(b)) < similarity * max(len(a), len(b)):
                continue
            both = len(np.intersect1d(a, b, assume_unique=True))
            if (both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0) >= similarity:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    least: dict = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return [least[find(i)] for i in range(len(docs))]


def test_whole_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = toxicity.fit(docs, read_table(spark, data, "labels"))
    lookup = toxicity.Lookup(model.lexicon)
    kept = [r for r in docs.collect() if toxicity.judge_text(r["text"] or "", model, lookup)[0] < corpus_pipeline.TOXIC]
    stage1 = corpus_pipeline.drop_toxic(spark, docs, data)
    assert sorted(r["doc_id"] for r in rows_of(stage1)) == sorted(r["doc_id"] for r in kept)

    component = near_copies([(r["doc_id"], r["text"]) for r in kept])
    kept = [r for r, c in zip(kept, component, strict=True) if c == r["doc_id"]]
    stage2 = corpus_pipeline.drop_near_copies(spark, stage1, data)
    assert sorted(r["doc_id"] for r in rows_of(stage2)) == sorted(r["doc_id"] for r in kept)

    learned = secrets.learn(stage2)
    clean = {r["doc_id"]: r["text"] if r["text"] is None else secrets.redact_text(r["text"], secrets.all_spans(r["text"], learned), "[secret]") for r in kept}
    stage3 = corpus_pipeline.redact_secrets(spark, stage2, data)
    assert {r["doc_id"]: r["text"] for r in rows_of(stage3)} == clean
    assert all(r["n_chars"] == len(r["text"] or "") for r in rows_of(stage3))

    stage4 = rows_of(corpus_pipeline.mix_sources(spark, stage3, data))
    words, sizes, taken = Counter(), Counter(), Counter()
    for r in stage4:
        words[r["doc_id"]] += len(WORD.findall(r["text"]))
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert clean[r["doc_id"]] == r["text"] or " ".join(WORD.findall(clean[r["doc_id"]])).startswith(r["text"])
    for r in kept:
        n = len(WORD.findall(clean[r["doc_id"]] or ""))
        sizes[r["source"]] += n
        assert words[r["doc_id"]] <= 2 * n
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.01)

    encoding = bpe.load_encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    final = corpus_pipeline.run(spark, data).collect()
    assert Counter((r["doc_id"], bytes(r["ids"])) for r in final) == Counter((r["doc_id"], np.array(encoding.encode_ordinary(r["text"]), "<u4").tobytes()) for r in stage4)
    assert all(r["exact"] and len(r["ids"]) == 4 * r["n_tokens"] for r in final)


def odd_documents(spark):
    r = random.Random(5)
    text = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    rows = [
        (1, None, None, None, None, "x", 1), (2, "", "en", "a", 0, "x", 1), (3, "   ", "en", "a", 3, "x", 1), (4, text(30), "en", "a", 7, "x", 1), (4, text(31), "en", "a", 7, "x", 1),
        (5, "password = hunter2hunter2 " + text(40), "en", None, 7, None, None), (6, text(100_000), "de", "b", 7, "x", 1), (None, text(20), "en", "b", None, "x", 1), (7, "same words here", "en", "b", 7, "x", 1), (7, "same words here", "en", "b", 7, "x", 1),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, ids int")


def test_stages_on_odd_documents(spark, data):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == corpus_pipeline.COLUMNS, name
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    ids = Counter(r["doc_id"] for r in docs.collect())
    assert ids[4] and ids[5] and ids[6] and ids[7] and ids[None]
    assert not docs.where(F.col("text").contains("hunter2")).count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert last.count() == docs.count() and last.where("not exact").count() == 0


def test_stages_on_no_documents(spark, data):
    docs = odd_documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, data).count() == 0


def test_stage_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near-dedup", "secret scan", "source mix", "byte-level bpe"]
