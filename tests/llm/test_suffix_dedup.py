"""Removal of repeated byte strings against every window of every document."""

import hashlib
import random

import numpy as np
import pytest

from quireloom.llm import queries, suffix_dedup


def by_windows(docs, length=50):
    """docs: (id, bytes) -> [(id, n_bytes, spans, kept)], by the definition."""
    order = lambda i: suffix_dedup.LAST if i is None else i
    first: dict = {}
    for i, t in docs:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            first[w] = min(first.get(w, order(i)), order(i))
    out = []
    for i, t in docs:
        gone = np.zeros(len(t) + 2, bool)
        for s in range(len(t) - length + 1):
            if first[t[s : s + length]] < order(i):
                gone[s + 1 : s + 1 + length] = True
        turn = np.flatnonzero(np.diff(gone.astype(np.int8)))
        spans = [(int(a), int(b)) for a, b in zip(turn[::2], turn[1::2], strict=True)]
        kept = bytes(np.frombuffer(t, np.uint8)[~gone[1 : len(t) + 1]]) if t else b""
        out.append((i, len(t), spans, kept))
    return out


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3]))


def run(spark, docs, parts=3):
    df = spark.createDataFrame([(i, t) for i, t in docs], "doc_id long, text string").repartition(parts)
    rows = suffix_dedup.remove_repeats(df).collect()
    return sorted_rows([(r["doc_id"], r["n_bytes"], [(s["start"], s["end"]) for s in r["spans"]], bytes(r["kept"])) for r in rows])


def test_query_against_brute_force(spark, data):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in queries.QUERIES["op7_suffix_dedup"](spark, data).collect()}
    assert got == {i: (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in by_windows(docs)}


def passages(seed, n=120):
    """Texts that share passages around the length, copies, and runs of one character."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß漢 ") for _ in range(r.randint(2, 9)))
    shared = ["".join(word() for _ in range(30))[: r.randint(40, 75)] for _ in range(12)] + ["x" * 120, "ab" * 60, "=" * 49, "=" * 50]
    docs = []
    for i in range(n):
        parts = [r.choice(shared) if r.random() < 0.4 else "".join(word() for _ in range(r.randint(0, 25))) for _ in range(r.randint(0, 8))]
        docs.append((i, "".join(parts)))
    docs += [(200 + i, docs[i][1]) for i in range(0, 40, 3)]
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_texts(spark, monkeypatch, seed):
    docs = passages(seed)
    if seed == 2:  # documents in many packs, suffixes in many buckets
        monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 2_000)
        monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 500)
    assert run(spark, docs) == sorted_rows(by_windows([(i, t.encode()) for i, t in docs]))


def test_one_lead_in_very_many_contexts(spark, monkeypatch):
    """A header that most texts hold, with other bytes around it: its windows are dealt one by one."""
    monkeypatch.setattr(suffix_dedup, "PACK_BYTES", 4_000)
    monkeypatch.setattr(suffix_dedup, "RANGE_BYTES", 2_000)
    seen = []
    whole = suffix_dedup.split_leads
    monkeypatch.setattr(suffix_dedup, "split_leads", lambda leads, n: (seen.append(whole(leads, n)), seen[-1])[1])
    r = random.Random(8)
    tail = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    docs = [(i, tail(r.randint(0, 60)) + "The header that nearly all of the texts hold" + r.choice(["x" * 20, "y" * 20, tail(20)]) + tail(40)) for i in range(400)]
    docs += [(1_000 + i, docs[i][1]) for i in range(0, 100, 7)]
    assert run(spark, docs) == sorted_rows(by_windows([(i, t.encode()) for i, t in docs]))
    assert len(seen[0][1]) > 0


def test_bytes_decide_where_hashes_agree(monkeypatch):
    """With one hash for all bytes to the left, a bucket gives the same masks."""
    r = np.random.default_rng(6)
    n, left, right = 300, suffix_dedup.REACH, suffix_dedup.LENGTH
    context = np.tile(np.frombuffer(b"a" * suffix_dedup.WIDTH, np.uint8), (n, 1)).copy()
    context[:, :left] = r.choice([97, 98], (n, left), p=[0.97, 0.03])
    ids, full = r.integers(0, 200, n), np.full(n, 1)
    want = suffix_dedup.compare(ids, full * left, full * right, context)
    monkeypatch.setattr(suffix_dedup, "STEP", 0)
    assert (suffix_dedup.compare(ids, full * left, full * right, context) == want).all()
    seen: dict = {}
    for i, c in zip(ids.tolist(), context, strict=True):
        for o in range(left + 1):
            key = o, c[left - o : left - o + suffix_dedup.LENGTH].tobytes()
            seen[key] = min(seen.get(key, i), i)
    for i, c, m in zip(ids.tolist(), context, want.tolist(), strict=True):
        assert all((m >> o & 1) == (seen[o, c[left - o : left - o + suffix_dedup.LENGTH].tobytes()] < i) for o in range(left + 1))


def test_the_greatest_id_and_none(spark):
    docs = [(2**63 - 1, "z" * 60), (None, "z" * 60), (None, "y" * 60), (2**63 - 1, "y" * 60)]
    got = run(spark, docs)
    assert [i for i, *_ in got] == [2**63 - 1, 2**63 - 1, None, None] and all(not spans for _, _, spans, _ in got)


def test_edges(spark):
    long = "".join(random.Random(9).choice("abcdefgh ") for _ in range(400_000))
    docs = [(5, None), (4, ""), (3, "short"), (7, "p" * 49), (8, "p" * 49), (6, long), (9, "q" + long[1_000:1_200]), (10, long), (10, long), (None, long[:100]), (None, long[:100]), (1, "ü" * 60), (2, "ü" * 60)]
    want = [(10 if i == 10 else i, (t or "").encode()) for i, t in docs]
    got = run(spark, docs)
    fixed = sorted_rows([(i, n, s, k) for i, n, s, k in by_windows_of_long(want)])
    assert got == fixed
    clash = spark.createDataFrame([(1, "a", b"k", 3)], "doc_id long, text string, kept binary, n_bytes int")
    assert suffix_dedup.remove_repeats(clash).columns == ["doc_id", "n_bytes", "spans", "kept"]
    assert suffix_dedup.remove_repeats(clash.limit(0)).count() == 0


def by_windows_of_long(docs):
    return by_windows(docs)


def test_multikey_order():
    r = np.random.default_rng(3)
    for n in (0, 1, 500, 5_000):
        words = r.integers(0, 3, (n, 6)).astype(np.uint64)
        order = suffix_dedup.multikey_order(words)
        rows = [tuple(x) for x in words[order].tolist()]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))


def test_anchors_are_found_in_every_window():
    """Equal windows have an anchor at the same offset, whatever stands around them."""
    r = random.Random(4)
    same = bytes(r.randrange(256) for _ in range(50))
    for n in (0, 7, 1 << 17):
        data = bytes(r.randrange(97, 101) for _ in range(n)) + same + bytes(r.randrange(97, 101) for _ in range(60))
        size, ids = np.array([len(data)], "<i8"), np.array([1], "<i8")
        pack = suffix_dedup.Pack({"docs": 1, "pack": 0, "head": suffix_dedup._zip(size, ids, np.zeros(1, "u1")), "body": suffix_dedup._zip(np.frombuffer(data, np.uint8))})
        pos, value, _ = pack.anchors()
        inside = pos[(pos >= n) & (pos <= n + suffix_dedup.REACH)] - n
        raw = np.concatenate([np.frombuffer(same, np.uint8), np.zeros(32, np.uint8)])
        h = suffix_dedup.gram_hashes(raw, 0, suffix_dedup.REACH + 1)
        assert int(h.argmin()) in inside.tolist()
        # and each window of the text has one
        assert (np.diff(np.concatenate([[-1], pos, [len(data)]])) <= suffix_dedup.LENGTH).all()
