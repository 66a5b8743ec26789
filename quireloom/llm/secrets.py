"""Secret scans: fixed patterns, and formats learned by grammar inference.

Base spans come from three patterns.  Beyond them, every run of 16 and more
characters that a credential may be made of is a candidate, whether a base span
touches it or not, and two probabilistic automata score it: one inferred from
labelled credentials, one from ordinary strings.  Each is a prefix tree whose
states are merged as long as a Hoeffding test finds their frequencies
compatible.  A run whose log-likelihood ratio for a character exceeds the
threshold is a span of kind ``format``; where a base span covers the same run
both are reported.

The labelled credentials are the secrets that the base patterns find in the
documents themselves, at most ``MOST_LABELLED`` distinct ones in hashed order,
with strings of public formats beside them; the ordinary strings are runs of the
documents that no base span touches, as many at most, with made-up ordinary ones
(words, paths, dates, numbers, UUIDs, plain ids) beside them; unlabelled runs that
look more like the credentials are taken out of these.  A quarter of both
is held out from the automata: the threshold leaves ``MOST_WRONG`` of the
held-out ordinary strings above it.

Defined results: a null or empty text has no spans; spans are in code points,
end exclusive, ordered by start and then kind; repeated rows repeat; an empty
table gives an empty table; without documents the made-up strings alone teach;
an input column ``spans`` gives way to the output.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireloom.llm.common import add_columns, slices, texts_of
from quireloom.session import materialize, ship_package

KINDS = ("assign", "access", "hex", "format")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
RUN = re.compile(r"(?<![A-Za-z0-9+/_.-])[A-Za-z0-9+/_.-]{16,}={0,2}")

PER_FORMAT, ALPHA, FLOOR, BACK_OFF = 80, 0.02, 1e-4, 0.1
#: Most labelled strings of either kind that the documents give, characters of one that count, and the
#: share of held-out ordinary strings that may score above the threshold.
MOST_LABELLED, MOST_LENGTH, MOST_WRONG = 600, 256, 0.02


class Automaton:
    """A probabilistic automaton, inferred from strings of symbols by state merging."""

    def __init__(self, samples: list[list], alpha: float = ALPHA) -> None:
        self.to: list[dict] = [{}]
        self.seen: list[dict] = [{}]
        self.stops, self.visits = [0], [0]
        for word in samples:
            s = 0
            self.visits[0] += 1
            for x in word:
                self.seen[s][x] = self.seen[s].get(x, 0) + 1
                if x not in self.to[s]:
                    self.to[s][x] = len(self.to)
                    self.to.append({})
                    self.seen.append({})
                    self.stops.append(0)
                    self.visits.append(0)
                s = self.to[s][x]
                self.visits[s] += 1
            self.stops[s] += 1
        self._merge_states(math.sqrt(0.5 * math.log(2 / alpha)))
        self._drop_what_was_merged()
        self.log = [{x: math.log(n / self.visits[s]) for x, n in self.seen[s].items()} for s in range(len(self.to))]
        all_seen: dict = {}
        for row in self.seen:
            for x, n in row.items():
                all_seen[x] = all_seen.get(x, 0) + n
        steps = sum(all_seen.values())
        self.anywhere, self.never = {x: math.log(BACK_OFF * n / steps + FLOOR) for x, n in all_seen.items()}, math.log(FLOOR)
        self.end = [math.log(max(FLOOR, n / max(1, v))) for n, v in zip(self.stops, self.visits, strict=True)]

    def _alike(self, a: int, b: int, bound: float) -> bool:
        """Whether all frequencies from the two states on agree up to the Hoeffding bound."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            n, m = self.visits[p], self.visits[q]
            most = bound * (n**-0.5 + m**-0.5)
            if abs(self.stops[p] / n - self.stops[q] / m) > most:
                return False
            for x in self.seen[p].keys() | self.seen[q].keys():
                if abs(self.seen[p].get(x, 0) / n - self.seen[q].get(x, 0) / m) > most:
                    return False
                if x in self.to[p] and x in self.to[q]:
                    todo.append((self.to[p][x], self.to[q][x]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Pour the tree below ``b`` into ``a``."""
        todo = [(a, b)]
        while todo:
            p, q = todo.pop()
            self.visits[p] += self.visits[q]
            self.stops[p] += self.stops[q]
            for x, n in self.seen[q].items():
                self.seen[p][x] = self.seen[p].get(x, 0) + n
                if x in self.to[p]:
                    todo.append((self.to[p][x], self.to[q][x]))
                else:
                    self.to[p][x] = self.to[q][x]

    def _drop_what_was_merged(self) -> None:
        """Keep the states that can be reached; what was poured into others would count twice."""
        order, new = [0], {0: 0}
        for s in order:
            for t in self.to[s].values():
                if t not in new:
                    new[t] = len(order)
                    order.append(t)
        self.to = [{x: new[t] for x, t in self.to[s].items()} for s in order]
        self.seen, self.stops, self.visits = ([old[s] for s in order] for old in (self.seen, self.stops, self.visits))

    def _merge_states(self, bound: float) -> None:
        red = [0]
        is_red = {0}
        while True:
            # the most visited state at the border goes first: its test says most
            blue = max(((self.visits[t], -t, s, x) for s in red for x, t in self.to[s].items() if t not in is_red), default=None, key=lambda v: v[:2])
            if blue is None:
                return
            _, t, s, x = blue
            t = -t
            for r in red:
                if self._alike(r, t, bound):
                    self.to[s][x] = r
                    self._fold(r, t)
                    break
            else:
                red.append(t)
                is_red.add(t)

    def loglik(self, word) -> float:
        s, total = 0, 0.0
        for x in word:
            step = self.log[s].get(x)
            if step is None:  # not seen from here: what it is worth anywhere, and the state stays
                total += self.anywhere.get(x, self.never)
                continue
            total += step
            s = self.to[s][x]
        return total + self.end[s]


def symbols(text: str) -> list:
    """Classes of characters; punctuation stands for itself."""
    out: list = []
    for c in text:
        if "0" <= c <= "9":
            out.append(0)
        elif "a" <= c <= "f":
            out.append(1)
        elif "g" <= c <= "z":
            out.append(2)
        elif "A" <= c <= "F":
            out.append(3)
        elif "G" <= c <= "Z":
            out.append(4)
        else:
            out.append(c)
    return out


UP, LOW, NUM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def labelled(seed: int = 7, each: int = PER_FORMAT) -> tuple[list[str], list[str]]:
    """Credentials and ordinary strings, made from public formats."""
    r = random.Random(seed)
    take = lambda alphabet, n: "".join(r.choice(alphabet) for _ in range(n))
    alnum, b64, url64 = UP + LOW + NUM, UP + LOW + NUM + "+/", UP + LOW + NUM + "-_"
    word = lambda: "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "ent", "ion", "que", "sch", "ung", "los", "aci", "el", "ou", "ti", "a", "e", "i", "o", "st", "le")) for _ in range(r.randint(1, 5)))
    good = [
        lambda: "AKIA" + take(UP + NUM, 16), lambda: "ASIA" + take(UP + NUM, 16), lambda: "ghp_" + take(alnum, 36), lambda: "gho_" + take(alnum, 36), lambda: "ghs_" + take(alnum, 36),
        lambda: f"xoxb-{take(NUM, 12)}-{take(NUM, 12)}-{take(alnum, 24)}", lambda: f"xoxp-{take(NUM, 12)}-{take(NUM, 12)}-{take(alnum, 24)}", lambda: "AIza" + take(url64, 35),
        lambda: "sk_live_" + take(alnum, 24), lambda: "sk_test_" + take(alnum, 24), lambda: "npm_" + take(alnum, 36), lambda: "glpat-" + take(url64, 20), lambda: take(NUM + "abcdef", r.choice((32, 40, 64))),
        lambda: f"eyJ{take(url64, 33)}.eyJ{take(url64, 60)}.{take(url64, 43)}", lambda: take(b64, 40),
    ]
    plain = [
        lambda: (word() + word() + word() + word() + word() + word())[:32], lambda: "_".join(word() for _ in range(r.randint(3, 6))), lambda: "-".join(word() for _ in range(r.randint(3, 6))),
        lambda: "/".join(word() for _ in range(r.randint(3, 7))), lambda: ".".join(word() for _ in range(r.randint(3, 6))), lambda: "".join(word().capitalize() for _ in range(r.randint(3, 6))),
        lambda: f"{word()}/{take(NUM, 4)}/{take(NUM, 2)}/{take(NUM, 2)}/{word()}-{word()}.html", lambda: take(NUM, r.randint(16, 24)), lambda: "=" * r.randint(16, 60), lambda: "-" * r.randint(16, 60), lambda: "_" * r.randint(16, 60), lambda: "." * r.randint(16, 60),
        lambda: f"{take(NUM, 4)}-{take(NUM, 2)}-{take(NUM, 2)}.{take(NUM, 6)}", lambda: (word() + word() + word()).upper() + "_" + word().upper() + word().upper(), lambda: f"{word()}{word()}.{word()}{take(NUM, 3)}.example.com", lambda: r.choice(LOW) * r.randint(16, 40),
        lambda: f"{word()}.{word()}={word()}-{take(NUM, 2)}.{take(NUM, 1)}", lambda: f"{word()}-{word()}-{take(NUM, 6)}-{word()}", lambda: f"{word()}{take(NUM, 1)}.{word()}.{r.choice(('com', 'net', 'org'))}", lambda: f"{word()}.{word()}.{take(NUM, 2)}.{word()}",
        lambda: "-".join(take(NUM + "abcdef", n) for n in (8, 4, 4, 4, 12)), lambda: "-".join(take(NUM + "ABCDEF", n) for n in (8, 4, 4, 4, 12)), *[lambda: take(alnum, r.randint(16, 24))] * 3, *[lambda: take(LOW + NUM, r.randint(16, 24))] * 2,
        lambda: f"{take(NUM, 3)}-{take(NUM, 3)}-{take(NUM, 4)}-{take(NUM, 4)}", lambda: f"{word()}{take(NUM, 2)}_{word()}{take(NUM, 2)}_{word()}",
    ]
    long = lambda f: next(s for s in iter(f, None) if len(s) >= 16)
    return [long(f) for f in good for _ in range(each)], [long(f) for f in plain for _ in range(each)]


def score(text: str, good: Automaton, plain: Automaton) -> float:
    """Log-likelihood ratio of being a credential, for a character."""
    s = symbols(text)
    return (good.loglik(s) - plain.loglik(s)) / max(1, len(s))


@dataclass
class Learned:
    """Both automata and the threshold, with what they do to held-out strings."""

    good: Automaton
    plain: Automaton
    least: float
    precision: float = 1.0
    recall: float = 1.0


def held_out(strings: list[str]) -> tuple[list[str], list[str]]:
    """Three quarters to learn from and one to judge by, by hash."""
    import xxhash

    last = [s for s in strings if xxhash.xxh64_intdigest(s.encode(), 11) % 4 == 3]
    apart = set(last)
    return [s for s in strings if s not in apart], last


def infer(secrets: list[str], ordinary: list[str]) -> Learned:
    """Automata from labelled strings of the documents and made-up ones.

    Runs of the documents that no pattern labels may be credentials all the
    same: those that a first pair of automata finds likelier so do not count as
    ordinary for the second.
    """
    made, plain = labelled()
    if ordinary:
        first = [Automaton([symbols(x[:MOST_LENGTH]) for x in held_out(some)[0]]) for some in (secrets + made, ordinary + plain)]
        ordinary = [x for x in ordinary if score(x, *first) <= 0]
    (good, good_last), (other, other_last) = held_out(secrets + made), held_out(ordinary + plain)
    a, b = Automaton([symbols(x[:MOST_LENGTH]) for x in good]), Automaton([symbols(x[:MOST_LENGTH]) for x in other])
    wrong = np.array([score(x, a, b) for x in other_last])
    least = max(0.0, float(np.quantile(wrong, 1 - MOST_WRONG)))
    found, false = sum(score(x, a, b) > least for x in good_last), int((wrong > least).sum())
    return Learned(a, b, least, found / max(1, found + false), found / max(1, len(good_last)))


LABELLED = "secret boolean, text string, place long"


def learn(df: DataFrame, text_col: str = "text") -> Learned:
    """The automata of a table of documents, from at most ``MOST_LABELLED`` distinct strings of each kind."""
    ship_package(df.sparkSession)

    def run(batches):
        import xxhash

        for batch in batches:
            for part in slices(batch, text_col):
                seen: dict = {}
                for text in texts_of(part.column(text_col)):
                    base = base_spans(text)
                    for a, k, b in base:
                        value = ASSIGN.fullmatch(text, a, b)[2] if k == 0 else text[a:b]
                        if len(value) >= 16:
                            seen[value, True] = None
                    for m in RUN.finditer(text):
                        if not any(s < m.end() and m.start() < e for s, _, e in base):
                            seen[m[0], False] = None
                rows = sorted((xxhash.xxh64_intdigest(t.encode("utf-8", "replace"), 5) >> 1, t, y) for t, y in seen)
                rows = [r for y in (True, False) for r in [r for r in rows if r[2] is y][:MOST_LABELLED]]
                yield pa.RecordBatch.from_arrays([pa.array([y for *_, y in rows], pa.bool_()), pa.array([t for _, t, _ in rows], pa.string()), pa.array([h for h, *_ in rows], pa.int64())], names=["secret", "text", "place"])

    found = df.select(text_col).mapInArrow(run, LABELLED).groupBy("secret", "text", "place").count()
    found = materialize(found, "labelled")  # two selections from one pass over the texts
    both = found.where("secret").orderBy("place", "text").limit(MOST_LABELLED).unionByName(found.where("not secret").orderBy("place", "text").limit(MOST_LABELLED))
    rows = both.select("secret", "text").collect()  # at most twice MOST_LABELLED rows
    some = sorted(r["text"] for r in rows if r["secret"])
    return infer(some, sorted({r["text"] for r in rows if not r["secret"]} - set(some)))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, in order."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def all_spans(text: str, learned: Learned) -> list[tuple[int, int, int]]:
    more = [(m.start(), 3, m.end()) for m in RUN.finditer(text) if score(m[0], learned.good, learned.plain) > learned.least]
    return sorted(base_spans(text) + more)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find(df: DataFrame, text_col: str = "text", keep_text: bool = True, learned: Learned | None = None) -> DataFrame:
    """Add ``spans``; the automata are those of ``df`` unless others are given."""
    learned = learned or learn(df, text_col)

    def make():
        def kernel(batch):
            rows = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in all_spans(t, learned)] for t in texts_of(batch.column(text_col))]
            return [pa.array(rows, ARROW_SPANS)]

        return kernel

    return add_columns(df, [T.StructField("spans", SPANS)], make, by=text_col, drop=() if keep_text else (text_col,))


def redact_text(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text", mark: str = "[secret]", learned: Learned | None = None) -> DataFrame:
    """Replace every span by ``mark``; a null text stays null."""
    learned = learned or learn(df, text_col)
    order = df.columns

    def make():
        def kernel(batch):
            rows = [t if t is None else redact_text(t, all_spans(t, learned), mark) for t in batch.column(text_col).to_pylist()]
            return [pa.array(rows, pa.string())]

        return kernel

    return add_columns(df, [T.StructField(text_col, T.StringType())], make, by=text_col).select(*order)
