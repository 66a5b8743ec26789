"""SimHash near-duplicates against brute force over all pairs."""

import random
import re

import numpy as np
import xxhash

from quireloom.llm import components, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def shingles(text, k):
    w = words_of(text)
    return [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []


def print_of(text, k=4):
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles(text, k)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def labels(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def close(prints, radius=4):
    return [(i, j) for i in range(len(prints)) for j in range(i) if bin(prints[i] ^ prints[j]).count("1") <= radius]


def test_query_against_brute_force(spark, data):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.QUERIES["op6_simhash"](spark, data).collect()}
    prints = [print_of(t) for _, t in docs]
    least = labels(len(docs), close(prints))
    assert got == {i: (f"{p:016x}", docs[r][0]) for (i, _), p, r in zip(docs, prints, least, strict=True)}


def test_links_of_many_and_of_hot_groups(spark, monkeypatch):
    """Random fingerprints, chains at the radius, and a group far above the size of a tile."""
    monkeypatch.setattr(simhash, "GROUP", 64)
    r = random.Random(5)
    some = {r.getrandbits(64) for _ in range(600)}
    for p in list(some)[:60]:  # chains: each link at the radius, the ends apart
        for _ in range(4):
            p ^= sum(1 << b for b in r.sample(range(64), 4))
            some.add(p)
    for _ in range(300):  # one block of high bits in common
        some.add((0xABCD << 48) | r.getrandbits(12) | r.getrandbits(4) << 30)
    some = sorted(some)
    ids = [int(np.uint64(p).view(np.int64)) for p in some]
    nodes = spark.createDataFrame([(i,) for i in ids], "node long").selectExpr("node", "node as w0").repartition(3)
    for n_nodes in (10, 1 << 20):  # few wide blocks, many narrow ones
        masks = simhash.block_masks(n_nodes, 4)
        links = simhash.links(nodes, ["w0"], masks, 4)
        root = {x["node"]: x["root"] for x in components.components(links).collect()}
        want = labels(len(some), close(some))
        classes: dict = {}
        for i, w in zip(ids, want, strict=True):
            classes.setdefault(w, set()).add(i)
        got: dict = {}
        for i in ids:
            got.setdefault(root.get(i, i), set()).add(i)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, classes.values()))


def test_carry_save_counters():
    r = np.random.default_rng(1)
    for radius in (1, 3, 4, 7, 20):
        one, two = (r.integers(0, 2**63, (n, 1), dtype=np.uint64) for n in (70, 130))
        two[:60] = one[:60] ^ (np.uint64(1) << r.integers(0, 64, (60, 1)).astype(np.uint64))
        i, j = simhash.tile_pairs(one, two, radius)
        want = {(a, b) for a in range(70) for b in range(130) if bin(int(one[a, 0] ^ two[b, 0])).count("1") <= radius}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_majority_of_many():
    r = np.random.default_rng(2)
    counts = np.array([0, 1, 2, 255, 256, 700, 0, 3])
    h = r.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    at, want = 0, []
    for n in counts:
        part = [int(x) for x in h[at : at + n]]
        want.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in part) > n))
        at += n
    assert simhash.majority(h, counts).tolist() == want


def corpus(seed=4, groups=25):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3_000)]
    docs = []
    for _ in range(groups):
        base = [r.choice(vocabulary) for _ in range(r.randint(60, 200))]
        docs.append(base)
        for edits in (0, 1, 2, 3, 6, 12, 30):
            words = list(base)
            for _ in range(edits):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            docs.append(words)
    return [(i, " ".join(w)) for i, w in enumerate(docs)] + [(9_000, ""), (9_001, None), (9_002, "one two"), (9_003, "ONE  two")]


def jaccard_pairs(texts, similarity, k=5):
    sets = [frozenset(shingles(t, k)) for t in texts]
    same = lambda a, b: (len(a & b) / len(a | b) if a | b else 1.0) >= similarity
    return [(i, j) for i in range(len(sets)) for j in range(i) if same(sets[i], sets[j])]


def test_similar_texts_against_brute_force(spark):
    docs = corpus()
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = labels(len(docs), jaccard_pairs([t for _, t in docs], 0.8))
    assert got == {i: docs[w][0] for (i, _), w in zip(docs, want, strict=True)}


def check_similar(spark, texts):
    docs = list(enumerate(texts))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want = labels(len(docs), jaccard_pairs(texts, 0.8))
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar(df).collect()} == dict(enumerate(want))
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == sorted(set(want))


def test_a_dominant_line_with_different_tails(spark):
    """A line that is repeated often fixes all majorities, whatever else stands there."""
    r = random.Random(6)
    text = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    texts = []
    for line, times, tail in ((text(9), 100, 300), (text(7), 60, 200), ("word", 400, 240)):
        texts += [f"{line} " * times + text(tail) for _ in range(3)]
        texts.append(texts[-1].upper())  # the same set of shingles
    check_similar(spark, texts)


def test_near_copies_that_differ_in_repeats(spark):
    """Sets of shingles count, not how often a line stands in a text."""
    r = random.Random(7)
    words = lambda n: [f"u{r.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n, size, times in ((300, 10, 10), (1_000, 20, 20), (300, 1, 200)):
        head, line, tail = words(n // 2), words(size), words(n // 2)
        texts += [" ".join(head + line * t + tail) for t in (1, times)]
    check_similar(spark, texts)


def test_a_large_group_of_near_copies(spark, monkeypatch):
    """A group of many tiles, each text a step away from the last."""
    monkeypatch.setattr(simhash, "TILE", 8)
    words = [f"a{i}" for i in range(120)]
    docs = []
    for i in range(150):
        words[i % 120] = f"b{i}"
        docs.append((i, " ".join(words)))
    docs += [(1_000 + i, docs[0][1]) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    want = labels(len(docs), jaccard_pairs([t for _, t in docs], 0.8))
    assert got == {i: docs[w][0] for (i, _), w in zip(docs, want, strict=True)}
    assert simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).count() == len(set(want))


def test_edges(spark):
    rows = [(3, None, "x"), (2, "", "x"), (4, "a b", "x"), (4, "a b", "x"), (5, "A  B\n", "x"), (None, "n", None), (None, "a b", None), (6, "word " * 100_000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Fp string")
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows) and got[0].asDict().keys() == {"doc_id", "fp", "component_id"}
    by = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    assert {c for (i, _), c in by.items() if i in (2, 3)} == {2} and {c for (i, f), c in by.items() if f == by_print("a b")} == {4}
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.similar(df.limit(0)).count() == 0
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted([(2, ""), (4, "a b"), (0, "n"), (6, "word " * 100_000)])
    assert simhash.keep_one(df.limit(0)).count() == 0


def by_print(text):
    return int(np.uint64(print_of(text)).view(np.int64))


def test_components_of_several_partitions(spark, monkeypatch):
    monkeypatch.setattr(components, "PART_LINKS", 50)
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(300)] + [(1_000, 1_000 + i) for i in range(1, 200)] + [(r.randrange(2_000, 2_400), r.randrange(2_000, 2_400)) for _ in range(150)] + [(7, 7)]
    r.shuffle(edges)
    got = {x["node"]: x["root"] for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = labels(3_000, edges)
    assert got == {i: w for i, w in enumerate(want) if i != w}
