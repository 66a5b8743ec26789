"""Toxicity by maximum-scoring segments.

Words, and their first 4 to 6 letters, get log-odds between toxic and other
labelled documents under an informative Dirichlet prior (pseudo-counts in
proportion to overall frequency); those that are significant and strong enter
the lexicon.  A word that is not in it has the score of its longest beginning
that is, so that inflected and disguised forms count.  A text is a
sequence of word scores with a negative drift for all others; one linear scan
finds every maximal scoring segment.  A segment's score turns into an
expectation over a clean text of that length by extreme-value statistics
(``E = K m exp(-lambda S)``); the evidence of all segments with ``E < 1`` adds up,
and a logistic curve, fitted on folds that did not feed the lexicon, turns it
into a probability.

The lexicon and the curve come from the rows of at most ``MOST_TRAIN`` labelled
ids, taken in hashed order, and ``MOST_WORDS`` words and beginnings at most; the
curve sees counts of evidence on a grid.  Scoring reads all texts whole.

Defined results: a null or empty text has no evidence and the score of such;
labels without an id or a value are ignored, of several labels of an id the
largest counts, and all rows with an id teach; without any labelled rows nothing is toxic (score 0); repeated
rows repeat; an empty table gives an empty table; input columns named like
outputs give way to them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireloom.llm.common import add_columns, slices, texts_of
from quireloom.session import ship_package

MOST_TRAIN, FOLDS, HELD_OUT = 20_000, (0, 1, 3), 2
#: The prior's weight as a share of the counts, the least z of a lexicon word, and the drift.
PRIOR, LEAST_Z, DRIFT = 0.05, 2.5, 0.25
#: Least log-odds of a lexicon entry, and the lengths of beginnings.
LEAST_ODDS, BEGIN = 2.0, (6, 5, 4)
#: Words that may be looked at for the lexicon, those in most toxic documents first; and the grid that the curve is fitted on.
MOST_WORDS, MOST_EVIDENCE, GRID = 200_000, 50, 64
WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    """The words of a text, each in lower case, so that their places are those of the text itself."""
    return [w.lower() for w in WORD.findall(text)]


@dataclass
class Model:
    lexicon: dict[str, float] = field(default_factory=dict)
    decay: float = 1.0
    log_k: float = 0.0
    slope: float = 0.0
    offset: float = -math.inf

    def probability(self, evidence: float) -> float:
        x = self.offset + self.slope * evidence
        return 0.0 if x < -700 else 1.0 / (1.0 + math.exp(-x))


def fold_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def log_odds(toxic: float, other: float, all_toxic: float, all_other: float) -> tuple[float, float]:
    """Log-odds ratio of a word under the prior, and its z-score."""
    prior = PRIOR * (toxic + other)
    a, b = toxic + prior, other + prior
    mass = PRIOR * (all_toxic + all_other)
    delta = math.log(a / (all_toxic + mass - a)) - math.log(b / (all_other + mass - b))
    return delta, delta / math.sqrt(1 / a + 1 / b)


def maximal_segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), in linear time (Ruzzo and Tompa, 1999).

    Each candidate keeps a link to the nearest one before it with a smaller sum
    at its left; a search follows these links, and what it passes over is
    merged or never looked at again.
    """
    total, found = 0.0, []  # (start, end, sum before, sum after, link)
    for i, x in enumerate(scores):
        if x <= 0:
            total += x
            continue
        start, before, after = i, total, total + x
        total = after
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= before:
                j = found[j][4]
            if j < 0 or found[j][3] >= after:
                break
            # the candidate grows to the left over number j and all behind it
            start, before, link = found[j][0], found[j][2], found[j][4]
            del found[j:]
            j = link
        found.append((start, i + 1, before, after, j))
    return [(a, b, y - x) for a, b, x, y, _ in found]


def tokens_of(text: str) -> set[str]:
    """The distinct words of a text and, marked by ``*``, their beginnings."""
    words = set(words_of(text))
    return words.union(*({w[:k] + "*" for w in words if len(w) >= k} for k in BEGIN))


class Lookup(dict):
    """Scores of words by the lexicon, remembered for the words of a task's texts."""

    MOST = 1 << 20

    def __init__(self, lexicon: dict[str, float]) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> float | None:
        found = self.lexicon.get(word)
        for k in BEGIN if found is None else ():
            if len(word) >= k and (found := self.lexicon.get(word[:k] + "*")) is not None:
                break
        if len(self) >= self.MOST:
            self.clear()
        self[word] = found
        return found


def scan(words: list[str], lookup: Lookup) -> list[tuple[int, int, float]]:
    """Maximal segments of a text in word positions; gaps between lexicon words are summed up first."""
    found = [lookup[w] for w in words]
    hits = [i for i, x in enumerate(found) if x is not None]
    if not hits:
        return []
    scores, at, last = [], [], -1
    for i in hits:
        scores += [-DRIFT * (i - last - 1), found[i]]
        at += [i, i]
        last = i
    return [(at[a], at[b - 1] + 1, s) for a, b, s in maximal_segments(scores)]


def evidence_of(segments, n_words: int, decay: float, log_k: float) -> float:
    """Nats by which the segments are rarer than one in a clean text of this length."""
    return sum(max(0.0, decay * s - log_k - math.log(max(1, n_words))) for _, _, s in segments)


def extreme_values(lexicon: dict[str, float], clean_rate: dict[str, float]) -> tuple[float, float]:
    """Decay (lambda) and log K of scores in clean text, where words come with ``clean_rate``."""
    rates = [(lexicon[w], clean_rate[w]) for w in lexicon]
    rest = max(0.0, 1.0 - sum(p for _, p in rates))

    def excess(t: float) -> float:
        return sum(p * math.exp(min(700.0, t * s)) for s, p in rates) + rest * math.exp(-t * DRIFT) - 1

    low, high = 1e-6, 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    if excess(low) > 0:  # no negative drift: nothing can be significant
        return 1e-6, 0.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low, math.log(max(1e-9, 1 - math.exp(-low * DRIFT)))


def _build(rows, cells: dict, leave_out: int | None) -> tuple[dict[str, float], float, float]:
    """Lexicon and extreme-value constants from per-fold counts."""
    folds = [f for f in FOLDS if f != leave_out]
    n1, n0 = (sum(cells.get((f, y), 0) for f in folds) for y in (1, 0))
    lexicon, rate = {}, {}
    for row in rows:
        y1, y0 = (sum(row[f"n{f}_{y}"] for f in folds) for y in (1, 0))
        if y1 + y0 and n1 and n0:
            delta, z = log_odds(y1, y0, n1, n0)
            if z >= LEAST_Z and delta >= LEAST_ODDS:
                lexicon[row["word"]], rate[row["word"]] = delta, (y0 + PRIOR * (y1 + y0)) / (n0 + PRIOR * (n1 + n0))
    decay, log_k = extreme_values(lexicon, rate) if lexicon else (1.0, 0.0)
    return lexicon, decay, log_k


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset of a logistic curve, with a little shrinkage."""
    b, weight = np.zeros(2), np.ones_like(x) if weight is None else weight
    design = np.stack([np.minimum(x, MOST_EVIDENCE), np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ b, -30, 30)))
        grad = design.T @ (weight * (y - p)) - np.array([0.05, 0.01]) * b
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([0.05, 0.01])
        step = np.linalg.solve(hess, grad)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(0.0, b[0])), float(b[1])


def training_rows(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, most: int) -> DataFrame:
    """(text, fold, toxic) of the rows of at most ``most`` labelled ids outside the held-out quarter."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic in (0, 1)")
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic")).withColumn("fold", fold_of(F.col("id"))).where(F.col("fold") != HELD_OUT)
    some = known.orderBy(F.xxhash64("id"), "id").limit(most)  # a proven bound for the broadcast
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id").select("text", "fold", "toxic")


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", most: int = MOST_TRAIN) -> Model:
    ship_package(docs.sparkSession)
    train = training_rows(docs, labels, text_col, id_col, label_col, most)

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                seen: Counter = Counter()
                for text, f, y in zip(texts_of(part.column("text")), part.column("fold").to_pylist(), part.column("toxic").to_pylist(), strict=True):
                    cell = 2 * f + y
                    words = tokens_of(text)
                    seen.update((w, cell) for w in words)
                    seen["", cell] += len(words)
                words, cells = zip(*seen, strict=True) if seen else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(cells, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["word", "cell", "n"])

    counts = train.mapInArrow(count, "word string, cell int, n long")
    table = counts.groupBy("word").agg(*[F.sum(F.when(F.col("cell") == 2 * f + y, F.col("n")).otherwise(0)).alias(f"n{f}_{y}") for f in FOLDS for y in (0, 1)])
    # a word with fewer toxic documents cannot reach the least z of a toxic word; the bounded sample bounds what is left
    toxic = sum(F.col(f"n{f}_1") for f in FOLDS)
    other = sum(F.col(f"n{f}_0") for f in FOLDS)
    known = table.where((F.col("word") == "") | ((toxic >= 3) & (toxic > other / 2)))
    rows = known.orderBy(F.col("word") != "", F.desc(toxic), "word").limit(MOST_WORDS + 1).collect()
    cells = {(f, y): r[f"n{f}_{y}"] for r in rows if r["word"] == "" for f in FOLDS for y in (0, 1)}
    rows = [r for r in rows if r["word"]]
    if not any(cells.get((f, 1)) for f in FOLDS) or not any(cells.get((f, 0)) for f in FOLDS):
        return Model()
    folds = {f: _build(rows, cells, f) for f in FOLDS}

    def measure(batches):
        lookups = {f: (Lookup(lexicon), decay, log_k) for f, (lexicon, decay, log_k) in folds.items()}
        for batch in batches:
            x = []  # evidence on a grid
            for text, f in zip(texts_of(batch.column("text")), batch.column("fold").to_pylist(), strict=True):
                lookup, decay, log_k = lookups[f]
                words = words_of(text)
                x.append(round(GRID * min(MOST_EVIDENCE, evidence_of(scan(words, lookup), len(words), decay, log_k))))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()), batch.column("toxic")], names=["x", "y"])

    sample = train.mapInArrow(measure, "x int, y int").groupBy("x", "y").count().orderBy("x", "y").toPandas().to_numpy(float)  # two rows for each step of the grid
    slope, offset = fit_curve(sample[:, 0] / GRID, sample[:, 1], sample[:, 2])
    lexicon, decay, log_k = _build(rows, cells, None)
    return Model(lexicon, decay, log_k, slope, offset)


PASSAGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
ARROW_PASSAGES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def judge_text(text: str, model: Model, lookup: Lookup) -> tuple[float, list[dict]]:
    """Score of a text and its significant passages, in code points."""
    words = words_of(text)
    segments = scan(words, lookup)
    least = (model.log_k + math.log(max(1, len(words)))) / model.decay
    passages = []
    if segments:
        at = [m.span() for m in WORD.finditer(text)]
        passages = [{"start": at[a][0], "end": at[b - 1][1], "score": s} for a, b, s in segments if s > least]
    return model.probability(evidence_of(segments, len(words), model.decay, model.log_k)), passages


def score(df: DataFrame, model: Model, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``score`` and ``passages``."""

    def make():
        lookup = Lookup(model.lexicon)

        def kernel(batch):
            found = [judge_text(t, model, lookup) for t in texts_of(batch.column(text_col))]
            return [pa.array([s for s, _ in found], pa.float64()), pa.array([p for _, p in found], ARROW_PASSAGES)]

        return kernel

    return add_columns(df, [T.StructField("score", T.DoubleType()), T.StructField("passages", PASSAGES)], make, by=text_col, drop=() if keep_text else (text_col,))
