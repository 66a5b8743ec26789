"""The source mix: targets by a plain loop, exact totals, bounds, and equal reruns."""

import re
from collections import Counter, defaultdict

import pytest

from quireloom.llm import mixing, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_by_loop(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Share by weight; cut what is above the cap; share the excess again until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while len(fixed) < len(order):
        free = [s for s in order if s not in fixed]
        rest, mass = total - sum(fixed.values()), sum(weight[s] for s in free)
        now = {s: rest * weight[s] / mass for s in free}
        over = [s for s in free if now[s] > most * sizes[s] * (1 + 1e-12)]
        if not over:
            return fixed | now
        fixed |= {s: most * sizes[s] for s in over}
    return fixed


def check(rows, docs):
    """rows: the mix; docs: (doc_id, text, source)."""
    assert len(rows) == len(docs)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t, _ in docs)
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 2 * r["size"]
    want = targets_by_loop(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], rel=1e-9, abs=1e-9)
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6
        assert {r["source_size"] for r in rows if r["source"] == s} == {sizes[s]}


def test_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "source")
    rows = queries.QUERIES["op3_source_mix"](spark, data)
    assert rows.columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]
    again = {r["doc_id"]: r["taken"] for r in queries.QUERIES["op3_source_mix"](spark, data).collect()}
    assert {r["doc_id"]: r["taken"] for r in rows.collect()} == again
    check(mixing.mix(docs).collect(), [tuple(r) for r in docs.collect()])


@pytest.mark.parametrize("shards", [1 << 20, 300])
def test_a_hot_source_and_null_ones(spark, shards):
    docs = [(i, "w " * (i % 17), None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 5}") for i in range(2_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3)
    mixed = mixing.mix(df, shard_words=shards)
    rows = mixed.collect()
    check(rows, docs)
    # every draw is its own: what the mix holds is what was taken, by document
    held = Counter()
    for r in mixing.emit(mixed).collect():
        held[r["doc_id"]] += len(WORD.findall(r["text"]))
    assert held == Counter({r["doc_id"]: r["taken"] for r in rows if r["taken"]})
    per_shard = Counter(d["shard"] for r in rows for d in r["draws"])
    if shards == 300:
        assert len(per_shard) > 10


def test_shards_are_fair_and_disjoint():
    quotas = [(1, 900), (2, 90), (3, 10)]
    run = mixing._shard_draws(quotas, 7, 17)
    import pandas as pd

    got = pd.concat(run([pd.DataFrame({"id": range(7)})]))
    for no, q in quotas:
        seats = sorted(x for _, r in got[got.no == no].iterrows() for x in range(r["first"], r["first"] + r["draws"]))
        assert seats == list(range(q))
    sizes = got.groupby("shard").draws.sum()
    assert sizes.max() - sizes.min() <= 1


def test_edges(spark):
    rows = [(1, None, "a", 3), (2, "", "a", 3), (3, " \t\n", "b", 3), (4, "x y z", "b", 3), (4, "x y z", "b", 3), (None, "n m", None, None), (5, "w " * 200_000, "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Size int")
    out = mixing.mix(df)
    check(out.collect(), [r[:3] for r in rows])
    assert sorted(out.columns) == sorted(["doc_id", "text", "source", "size", "source_size", "target", "draws", "taken"])
    assert mixing.mix(df.limit(0)).count() == 0
    assert mixing.emit(mixing.mix(df.limit(0))).count() == 0
    nothing = mixing.mix(df.where("doc_id < 4")).collect()
    assert len(nothing) == 3 and all(r["taken"] == 0 and r["target"] == 0 for r in nothing)


def test_more_draws_than_the_sampler_takes():
    """Counts stay exact and near their expectation on both sides of the sampler's limit."""
    import numpy as np

    for scale in (10**3, 10**10):
        counts = np.array([5, 1, 0, 3], np.int64) * scale
        left = mixing.split(np.random.default_rng(1), counts, 4 * scale)
        assert left.sum() == 4 * scale and (left >= 0).all() and (left <= counts).all()
        assert np.abs(left - counts * 4 / 9).max() <= 8 * scale**0.5
    assert mixing.split(np.random.default_rng(1), counts, 0).sum() == 0
    assert (mixing.split(np.random.default_rng(1), counts, int(counts.sum())) == counts).all()
