"""Toxicity: segments by their definition, held-out accuracy, and what labels may reach."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quireloom.llm import queries, toxicity


def segments_by_definition(scores):
    """The best segment first, then the same to its left and right (ties: the shortest, leftmost)."""
    found = []

    def split(lo, hi):
        best = max(((sum(scores[a:b]), -(b - a), -a) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return
        a, b = -best[2], -best[2] - best[1]
        found.append((a, b, best[0]))
        split(lo, a)
        split(b, hi)

    split(0, len(scores))
    return sorted(found)


def test_maximal_segments():
    r = random.Random(1)
    for _ in range(400):
        scores = [r.choice([-3, -2, -1, 1, 2, 5]) + r.random() * 1e-3 for _ in range(r.randint(0, 14))]
        got = toxicity.maximal_segments(scores)
        want = segments_by_definition(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_the_scan_is_linear():
    """Every new candidate passes over those before it once: a million scores take seconds."""
    import time

    began = time.time()
    found = toxicity.maximal_segments([1.0, -2.0] * 500_000)
    assert len(found) == 500_000 and time.time() - began < 20


def test_passages_keep_their_places(spark):
    """Lower case may be longer than the text itself; places are those of the text."""
    docs, labels = fixture(spark)
    model = toxicity.fit(docs, labels)
    text = "\u0130\u0130 \u0130 w1 " * 5 + "VILE scum filth" + " w4 w5" * 300
    passages = toxicity.judge_text(text, model, toxicity.Lookup(model.lexicon))[1]
    assert [text[p["start"] : p["end"]] for p in passages] == ["VILE scum filth"]


def best_first(scores):
    """Maximal segments of a long list: the best one by running sums, then both sides."""
    out, todo = [], [(0, len(scores))]
    while todo:
        lo, hi = todo.pop()
        best, low, total, at = (0.0, 0, 0), 0.0, 0.0, lo
        for i in range(lo, hi):
            total += scores[i]
            if total - low > best[0]:
                best = (total - low, at, i + 1)
            if total < low:
                low, at = total, i + 1
        if best[0] > 0:
            out.append(best)
            todo += [(lo, best[1]), (best[2], hi)]
    return out


def test_query_against_brute_force(spark, data):
    """Every score of the query, word by word from the definitions."""
    import re
    import zlib

    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{data}/labels.parquet").collect()}
    words = {i: [w.lower() for w in re.findall(r"\w+", t)] for i, t in docs}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in docs}
    train = [i for i, _ in docs if i in toxic and fold[i] != 2]
    marks = {i: set(words[i]) | {w[:k] + "*" for w in words[i] for k in (4, 5, 6) if len(w) >= k} for i in train}

    def learn(ids):
        n = [sum(len(marks[i]) for i in ids if toxic[i] == y) for y in (0, 1)]
        seen = ({}, {})
        for i in ids:
            for w in marks[i]:
                seen[toxic[i]][w] = seen[toxic[i]].get(w, 0) + 1
        lexicon, rate = {}, {}
        for w, a in seen[1].items():
            b = seen[0].get(w, 0)
            every = sum(w in marks[i] for i in train if toxic[i]), sum(w in marks[i] for i in train if not toxic[i])
            if every[0] < 3 or every[0] <= every[1] / 2:
                continue
            p, mass = 0.05 * (a + b), 0.05 * (n[0] + n[1])
            odds = [math.log((c + p) / (m + mass - c - p)) for c, m in ((a, n[1]), (b, n[0]))]
            delta = odds[0] - odds[1]
            if delta >= 2.0 and delta / math.sqrt(1 / (a + p) + 1 / (b + p)) >= 2.5:
                lexicon[w], rate[w] = delta, (b + p) / (n[0] + mass)
        return lexicon, *(toxicity.extreme_values(lexicon, rate) if lexicon else (1.0, 0.0))

    def evidence(i, model):
        lexicon, decay, log_k = model
        value = lambda w: next((lexicon[x] for x in (w, *(w[:k] + "*" for k in (6, 5, 4) if len(w) >= k)) if x in lexicon), -0.25)
        return sum(max(0.0, decay * s - log_k - math.log(max(1, len(words[i])))) for s, _, _ in best_first([value(w) for w in words[i]]))

    apart = {f: learn([i for i in train if fold[i] != f]) for f in (0, 1, 3)}
    x = np.array([round(64 * min(50, evidence(i, apart[fold[i]]))) / 64 for i in train])
    slope, offset = toxicity.fit_curve(x, np.array([toxic[i] for i in train], float))
    model = learn(train)
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op9_toxicity"](spark, data).collect()}
    assert len(got) == len(docs)
    assert got == pytest.approx({i: 1 / (1 + math.exp(-offset - slope * evidence(i, model))) for i, _ in docs}, abs=1e-6)


def test_gaps_are_summed():
    """Runs of words outside the lexicon count as one gap: the segments are those of the word sequence."""
    lookup = toxicity.Lookup({"bad": 2.0, "worse": 5.0})
    r = random.Random(2)
    for _ in range(200):
        words = [r.choice(["bad", "worse", "x", "y", "z"]) for _ in range(r.randint(0, 30))]
        scores = [{"bad": 2.0, "worse": 5.0}.get(w, -toxicity.DRIFT) for w in words]
        got, want = toxicity.scan(words, lookup), toxicity.maximal_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert [s for *_, s in got] == pytest.approx([s for *_, s in want])


def test_extreme_values():
    """The decay solves E[exp(t X)] = 1 for the scores of clean text."""
    lexicon, rate = {"a": 3.0, "b": 4.0}, {"a": 0.002, "b": 0.001}
    decay, _ = toxicity.extreme_values(lexicon, rate)
    mean = 0.002 * math.exp(3 * decay) + 0.001 * math.exp(4 * decay) + 0.997 * math.exp(-toxicity.DRIFT * decay)
    assert mean == pytest.approx(1.0, abs=1e-6)


@pytest.fixture(scope="module")
def scored(spark):
    data = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op9_toxicity"](spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", F.col("toxic").alias("y"))
    return rows, rows.join(labels, "doc_id").toPandas()


def test_held_out_accuracy(scored):
    _, known = scored
    held = known[known.held_out & known.y.notna()]
    tp, fp = int(((held.predicted == 1) & (held.y == 1)).sum()), int(((held.predicted == 1) & (held.y == 0)).sum())
    fn = int(((held.predicted == 0) & (held.y == 1)).sum())
    assert 2 * tp / (2 * tp + fp + fn) >= 0.85
    assert fp <= 0.02 * int((held.y == 0).sum())
    order = held.score.rank().to_numpy()
    pos = held.y.to_numpy() == 1
    auc = (order[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())
    assert auc >= 0.95


def test_columns_and_folds(scored):
    import zlib

    rows, known = scored
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    assert known.score.between(0, 1).all() and (known.predicted == (known.score >= 0.3)).all()
    assert (known.held_out == known.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()


def fixture(spark, n=400):
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 60))]
        bad = i % 4 == 0
        if bad:
            at = r.randrange(len(text))
            text[at:at] = [r.choice(["vile", "scum", "filth"]) for _ in range(4)]
        docs.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_labels_teach_nothing(spark):
    docs, labels = fixture(spark)
    fold = toxicity.fold_of(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(fold == toxicity.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)
    one, other = toxicity.fit(docs, labels), toxicity.fit(docs.orderBy(F.desc("doc_id")).repartition(5), labels.repartition(3))
    assert one.lexicon == other.lexicon and one.offset == pytest.approx(other.offset, abs=1e-6)


def test_passages(spark):
    docs, labels = fixture(spark)
    model = toxicity.fit(docs, labels)
    text = "w1 w2 w3 " * 20 + "vile scum filth" + " w4 w5" * 300 + " filth vile scum " + "w6 " * 30
    df = spark.createDataFrame([(1, text, 0.5, "x")], "doc_id long, text string, Score double, passages string")
    out = toxicity.score(df, model)
    assert out.columns == ["doc_id", "text", "score", "passages"]
    row = out.first()
    assert [text[p["start"] : p["end"]] for p in row["passages"]] == ["vile scum filth", "filth vile scum"]
    assert row["score"] > 0.9


def test_edges(spark):
    docs, labels = fixture(spark)
    odd = labels.union(spark.createDataFrame([(None, 1), (1, None), (2, 0), (9_999, 1), (3, 7)], "doc_id long, toxic int"))
    model = toxicity.fit(docs.union(spark.createDataFrame([(None, "vile"), (2, None)], "doc_id long, text string")), odd)
    rows = [(1, None), (2, ""), (3, "w1"), (3, "w1"), (None, "vile scum filth vile"), (4, "w1 " * 200_000)]
    got = [(r["doc_id"], r["score"]) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()]
    assert len(got) == len(rows) and all(0 <= s <= 1 for _, s in got)
    by = dict(got)
    assert by[1] == by[2] == by[3] < 0.3 < by[None]
    assert toxicity.score(docs.limit(0), model).count() == 0
    none = toxicity.fit(docs, labels.limit(0))
    assert none == toxicity.Model() and {r["score"] for r in toxicity.score(docs, none).select("score").distinct().collect()} == {0.0}
    assert toxicity.fit(docs.limit(0), labels) == toxicity.Model()


def test_curve():
    r = np.random.default_rng(4)
    x = np.concatenate([np.zeros(500), r.exponential(8, 300)])
    y = (r.random(800) < 1 / (1 + np.exp(3 - 0.8 * np.minimum(x, 50)))).astype(float)
    slope, offset = toxicity.fit_curve(x, y)
    assert slope == pytest.approx(0.8, abs=0.3) and offset == pytest.approx(-3, abs=0.8)
