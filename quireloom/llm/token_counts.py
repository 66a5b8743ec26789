"""Token counts by finite-state tokenizer compilation.

A byte-level BPE tokenizer is compiled into a deterministic transducer over
bytes whose transitions carry the number of tokens they add.  The state after
the prefix ``w`` of a pre-token holds, for each suffix of ``w`` that some token
starts with, the place in the token trie, the last token of the encoding before
that suffix, and the tokens it has less than the encoding of ``w``.  That is
enough: a sequence of tokens is the BPE encoding of its bytes exactly if each
neighbouring pair is, so the last token of a longer prefix is the one that goes
with the token before it.  States are found on demand, as lazy automata of
regular-expression engines are.  A table that is full, in the midst of a run
too, keeps the states that are still in use and forgets all others.

Texts are laid end to end and cut into chunks of equal length that run in
lockstep, at most ``LANES`` at a time.  A pre-token start resets the automaton,
so the state map of a chunk that holds one is constant: it says the exit state
whatever the entry was.  Chunks without one get a map over the entry states that
are live: the root, and where the chunk before ends if it is run from the root
(encodings soon fall into step, so that is mostly the true one).  Maps compose
pairwise in a parallel prefix scan of logarithmic depth, which gives every
chunk its entry state; a chunk that the scan reaches with a state outside its
map has its map extended, and the scan goes on.  Then all chunks run from their
true entries.  Where pre-tokens start is itself a finite-state question with one
character of look-ahead, answered for all characters at once.

Defined results: a null or empty text has 0 tokens and 0 bytes; special strings
inside texts count as one token, as the library's default has it; repeated rows
repeat; an empty table gives an empty table; an input column ``n_tokens`` gives
way to the output.
"""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quireloom.llm.common import add_columns, texts_of

SPACE, WHITE, LETTER, NUMBER, OTHER, UNKNOWN = range(6)
#: Length of the chunks that run in lockstep, their number, most states of the table and most remembered pairs.
CHUNK, LANES, MOST_STATES, MOST_PAIRS = 128, 1 << 14, 1 << 17, 1 << 19


class Splitter:
    """Where the byte-level pre-tokenizer starts a piece."""

    def __init__(self, pre_tokenizer) -> None:
        self.pre, self.table = pre_tokenizer, np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(np.arange(128))

    def _learn(self, code_points) -> None:
        """Classes as the library itself has them: a character is a letter if it joins one."""
        one_piece = lambda text: len(self.pre.pre_tokenize_str(text)) == 1
        for c in code_points:
            ch = chr(int(c))
            if ch == " ":
                self.table[c] = SPACE
            elif one_piece("a" + ch):
                self.table[c] = LETTER
            elif one_piece("1" + ch):
                self.table[c] = NUMBER
            elif one_piece("!" + ch):
                self.table[c] = OTHER
            else:
                self.table[c] = WHITE

    def starts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each character whether a piece starts there; ``first`` marks the starts of texts."""
        cls = self.table[cp]
        if (cls == UNKNOWN).any():
            self._learn(np.unique(cp[cls == UNKNOWN]))
            cls = self.table[cp]
        n = len(cp)
        white = cls <= WHITE
        before, gap = np.empty(n, np.uint8), np.empty(n, bool)
        before[0], before[1:] = UNKNOWN, cls[:-1]
        before[first] = UNKNOWN
        gap[:-1], gap[-1] = white[1:] | first[1:], True
        was_white = before <= WHITE
        # white space: a run starts, or its last character before something visible stands apart
        start = np.where(white, ~was_white | ~gap, (before != SPACE) & (was_white | (before != cls)))
        start |= first
        marks = np.flatnonzero((cp == 39) & (before != SPACE) & (before != OTHER))
        if len(marks):
            at = lambda k: np.where((marks + k < n), cp[np.minimum(marks + k, n - 1)], 0) * ~first[np.minimum(marks + k, n - 1)]
            one, two = at(1), at(2)
            two = np.where(one == 0, 0, two)
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((two == ord("e")) & ((one == ord("r")) | (one == ord("v")))) | ((one == ord("l")) & (two == ord("l")))
            for sel, k in ((short, 2), (long, 3)):
                m = marks[sel]
                start[m], start[m + 1] = True, False
                m = m[m + k < n]
                start[m + k] = True
        return start


class Transducer:
    """The lazily compiled automaton: ``to`` and ``adds`` by 256 * state + byte."""

    OPEN = 0  # the state of a chunk whose entry is not known yet: reads everything, adds nothing
    ROOT = 1

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("only byte-level BPE without a normalizer can be compiled")
        if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec["added_tokens"]):
            raise ValueError("added tokens that take white space or stand between words cannot be compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        # leftmost, and of those at one place the longest
        self.marks = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        byte = {c: b for b, c in self.char.items()}
        self.child: dict[int, int] = {}
        self.token, self.inner, self.text = [-1], [False], {}
        for word, i in spec["model"]["vocab"].items():
            if word in self.special:
                continue
            self.text[i], node = word, 0
            for c in word:
                key, self.inner[node] = node << 8 | byte[c], True
                node = self.child.get(key, 0)
                if not node:
                    node = self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.inner.append(False)
            self.token[node] = i
        self.pairs: dict[int, bool] = {}
        self.reset()

    def reset(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.states: list[tuple] = [(), ()]
        self.room = MOST_STATES + LANES + 2  # a step adds one state for each lane at most
        self.to, self.adds = np.empty(self.room * 256, np.int32), np.empty(self.room * 256, np.int8)
        self.to[:256], self.adds[:256], self.to[256:512] = self.OPEN, 0, -1
        root = ((0, -1, 0),)
        self.ids[root], self.states[self.ROOT] = self.ROOT, root

    def _state(self, key: tuple) -> int:
        found = self.ids.get(key)
        if found is None:
            found = self.ids[key] = len(self.states)
            self.states.append(key)
            self.to[found * 256 : found * 256 + 256] = -1
        return found

    def make_room(self, *held: np.ndarray) -> None:
        """Of a full table keep the states that ``held`` arrays name, and rename those there."""
        if len(self.states) <= MOST_STATES:
            return
        old, some = self.states, np.unique(np.concatenate([h.reshape(-1) for h in held]))
        some = some[some > self.ROOT]
        self.reset()
        self.room = max(self.room, len(some) + LANES + 2)
        if self.room * 256 > len(self.to):
            self.to, self.adds = (np.concatenate([x, np.empty(self.room * 256 - len(x), x.dtype)]) for x in (self.to, self.adds))
        new = np.array([self._state(old[s]) for s in some.tolist()], np.int64)
        for h in held:
            move = h > self.ROOT
            h[move] = new[np.searchsorted(some, h[move])]

    def _together(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side."""
        key = left << 20 | right
        if (known := self.pairs.get(key)) is None:
            if len(self.pairs) >= MOST_PAIRS:
                self.pairs.clear()
            got = self.tokenizer.model.tokenize(self.text[left] + self.text[right])
            known = self.pairs[key] = len(got) == 2 and got[0].id == left and got[1].id == right
        return known

    def _expand(self, state: int, byte: int) -> None:
        last, adds, moved = -1, 0, []
        for node, before, less in self.states[state]:
            nxt = self.child.get(node << 8 | byte)
            if nxt is None:
                continue
            token = self.token[nxt]
            if last < 0 and token >= 0 and (before < 0 or self._together(before, token)):
                last, adds = token, less + 1
            if self.inner[nxt]:
                moved.append((nxt, before, less))
        if last < 0:
            raise AssertionError("a prefix without an encoding")
        key = (*((n, b, less - adds) for n, b, less in moved), (0, last, 0))
        found = self._state(key)
        self.to[state * 256 + byte], self.adds[state * 256 + byte] = found, adds

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = state * 256 + byte
        to = self.to[at]
        if (to < 0).any():
            for x in np.unique(at[to < 0]).tolist():
                self._expand(x >> 8, x & 255)
            to = self.to[at]
        return to, self.adds[at]

    def run(self, data: np.ndarray, start: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """Tokens that each byte adds (they may be negative; sums count)."""
        out, enter = np.empty(len(data), np.int8), np.array([self.ROOT], np.int64)
        for at in range(0, len(data), chunk * LANES):
            stop = min(len(data), at + chunk * LANES)
            out[at:stop] = self._run_part(data[at:stop], start[at:stop], chunk, enter)
        return out

    def _lockstep(self, rows: np.ndarray, state: np.ndarray, length: np.ndarray, held: tuple, out: np.ndarray | None = None, flags: np.ndarray | None = None) -> None:
        """Run the first ``length`` bytes of each column of ``rows`` from ``state``, in place."""
        order = np.argsort(-length, kind="stable")
        size = length[order]
        for j in range(int(size[0]) if len(size) else 0):
            now = order[: int(np.searchsorted(-size, -j, side="left"))]
            if flags is not None:
                state[now[flags[j, now]]] = self.ROOT
            self.make_room(state, *held)
            moved, adds = self.step(state[now], rows[j, now])
            state[now] = moved
            if out is not None:
                out[j, now] = adds

    def _run_part(self, data: np.ndarray, start: np.ndarray, chunk: int, carry: np.ndarray) -> np.ndarray:
        """The same for at most ``LANES`` chunks; ``carry`` is the state before and becomes that behind."""
        n = len(data)
        lanes = -(-n // chunk)
        rows, flags = np.zeros(lanes * chunk, np.uint8), np.zeros(lanes * chunk, bool)
        rows[:n], flags[:n], flags[n:] = data, start, True
        rows, flags = np.ascontiguousarray(rows.reshape(lanes, chunk).T), np.ascontiguousarray(flags.reshape(lanes, chunk).T)
        out, whole = np.zeros((chunk, lanes), np.int8), np.full(lanes, chunk)
        if n % chunk:
            whole[-1] = n % chunk
        # constant maps, all at once, from an unknown entry
        leave = np.full(lanes, self.OPEN, np.int64)
        self._lockstep(rows, leave, whole, (carry,), out, flags)
        head = np.where(flags.any(0), flags.argmax(0), whole)
        enter = np.concatenate([carry, leave[:-1]])  # OPEN where it is not known yet
        open_ = np.flatnonzero(leave == self.OPEN)
        if len(open_):
            self._scan(rows, whole, open_, enter, leave, carry)
        todo = np.flatnonzero(head > 0)
        state = enter[todo]
        part = np.zeros((chunk, len(todo)), np.int8)
        self._lockstep(rows[:, todo], state, head[todo], (leave,), part)
        for k in np.unique(head[todo]).tolist():
            of = np.flatnonzero(head[todo] == k)
            out[:k, todo[of]] = part[:k, of]
        carry[0] = leave[-1]
        return np.ascontiguousarray(out.T).reshape(-1)[:n]

    def _scan(self, rows: np.ndarray, whole: np.ndarray, open_: np.ndarray, enter: np.ndarray, leave: np.ndarray, carry: np.ndarray) -> None:
        """Entry and exit states of the chunks without a start, by composed maps."""
        cells, size = np.ascontiguousarray(rows[:, open_]), whole[open_]
        first = np.concatenate([[True], np.diff(open_) > 1])  # of a run of such chunks; its entry is known
        # maps of two entries each: (into, out of)
        into = np.full((len(open_), 2), self.ROOT, np.int64)
        past = into.copy()
        held = (into, past, enter, leave, carry)
        state = into[:, 0].copy()
        self._lockstep(cells, state, size, held)
        past[:, 0] = state
        into[:, 1] = np.where(first, enter[open_], np.concatenate([[self.ROOT], past[:-1, 0]]))
        state = into[:, 1].copy()
        self._lockstep(cells, state, size, held)
        past[:, 1] = state
        run = np.cumsum(first) - 1
        origin = np.flatnonzero(first)[run]
        while True:
            # prefix scan: after step d a chunk's map covers the 2d chunks up to it, within its run
            begin = np.arange(len(open_))
            map_in, map_out = into.copy(), past.copy()
            while (begin > origin).any():
                grow = np.flatnonzero(begin > origin)
                left = begin[grow] - 1
                mid = map_out[left]  # what the earlier map leaves is looked up in the later one
                hit = mid[:, :, None] == map_in[grow][:, None, :]
                found = np.where(hit.any(axis=2), np.take_along_axis(map_out[grow], hit.argmax(axis=2), 1), -1)
                found[mid < 0] = -1
                map_in[grow], map_out[grow], begin[grow] = map_in[left], found, begin[left]
            given = enter[open_[origin]][:, None] == map_in
            end = np.where(given.any(axis=1), np.take_along_axis(map_out, given.argmax(axis=1)[:, None], 1)[:, 0], -1)
            known = np.concatenate([[True], end[:-1] >= 0]) | first
            stuck = np.flatnonzero((end < 0) & known)  # the first of each run whose map lacks its entry
            if not len(stuck):
                break
            state = np.where(first[stuck], enter[open_[stuck]], end[stuck - 1])
            into[stuck, 1] = state
            self._lockstep(cells[:, stuck], state, size[stuck], held)
            past[stuck, 1] = state
        leave[open_] = end
        enter[1:] = leave[:-1]


@lru_cache(maxsize=2)
def compiled(path: str) -> tuple[Transducer, Splitter]:
    t = Transducer(path)
    return t, Splitter(t.tokenizer.pre_tokenizer)


def count_tokens(texts: list[str], transducer: Transducer, splitter: Splitter, chunk: int = CHUNK) -> np.ndarray:
    counts = np.zeros(len(texts), np.int64)
    parts, owner = [], []
    for i, text in enumerate(texts):
        pieces = transducer.marks.split(text) if transducer.marks else [text]
        counts[i] = len(pieces) - 1
        for p in pieces:
            if p:
                parts.append(p)
                owner.append(i)
    if not parts:
        return counts
    joined = "".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    first_at = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    data = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
    if len(data) == len(joined):
        cp, offset = data, None
    else:
        cp = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        offset = np.concatenate([[0], np.cumsum(1 + (cp >= 0x80) + (cp >= 0x800) + (cp >= 0x10000))[:-1]])
    first = np.zeros(len(cp), bool)
    first[first_at] = True
    start = splitter.starts(cp, first)
    if offset is None:
        begin, at = start, first_at
    else:
        begin = np.zeros(len(data), bool)
        begin[offset[start]] = True
        at = offset[first_at]
    added = transducer.run(data, begin, chunk)
    np.add.at(counts, np.asarray(owner), np.add.reduceat(added, at, dtype=np.int64))
    return counts


def add_token_counts(df: DataFrame, path: str, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """Add ``n_tokens``, as the tokenizer file's library gives them without added special tokens."""

    def make():
        transducer, splitter = compiled(path)

        def kernel(batch):
            return [pa.array(count_tokens(texts_of(batch.column(text_col)), transducer, splitter), pa.int64())]

        return kernel

    return add_columns(df, [T.StructField("n_tokens", T.LongType())], make, by=text_col, drop=() if keep_text else (text_col,))
