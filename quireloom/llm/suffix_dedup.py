"""Removal of byte strings that repeat across documents, by partitioned suffix sorting.

A byte goes if it lies in a string of ``LENGTH`` bytes that also starts in a
document with a smaller id.  Suffixes are sorted, but not all of them: each
window of ``LENGTH`` bytes has the place of its least hashed ``GRAM``-gram, equal
windows have it at the same offset, and those anchors are one position in about
eighteen.  Three passes over packs of documents (compressed blocks of a few MB
in shared storage) do the work:

1. Each pack deals the hashes of its anchors, without repeats, to hash ranges;
   a range sends back to each pack those that a second document may hold.
2. Packs deal the suffixes at these anchors, with the bytes to their left, into
   buckets: ranges of the leading ``GRAM`` bytes, split at sampled splitters, and
   where the input asks for more buckets than splitters, parts of a range by a
   hash of these bytes.  Within a pack equal contexts of larger documents are
   settled at once and stay.
3. A bucket sorts its suffixes by multikey quicksort, a machine word at a time.
   Common prefixes of neighbours, with the bytes to the left, say which windows
   around the anchors are equal, and the smallest document of each class keeps
   its own.  Suffixes that share an anchor share its ``GRAM`` leading bytes, so
   none that must be compared lie across a boundary of two buckets.

Leading bytes that the sample finds very often (a header, a licence line) would
fill one bucket whatever the splitters.  Their windows are dealt one by one
instead, by a hash of the whole window, and compared as whole strings; of equal
windows in a pack only those of its smallest document travel.

Hashes only sort and deal: bytes are compared before any of them goes, but for
the hashes of pass 1, where an equal hash of different bytes costs work only.

Defined results: a null or empty text has no bytes; ids order documents, rows
without an id count as those of the greatest id, 2^63 - 1; rows with one id do
not remove each other's bytes;
texts shorter than ``LENGTH`` bytes stay whole; an empty table gives an empty
table; the result has the id and the columns named below only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireloom.session import materialize, release, ship_package

LENGTH, GRAM = 50, 16
REACH = LENGTH - GRAM  # an anchor lies at most so far behind the start of its window
PACK_BYTES, RANGE_BYTES, LEAST_RANGES = 6 << 20, 12 << 20, 64
#: Most splitters, strings sampled for each, packs that give them, and how many times its share of a bucket makes a lead hot.
MOST_SPLITTERS, SAMPLE, SAMPLE_PACKS, HOT = 4096, 256, 16, 4
LAST = np.int64(2**63 - 1)


def _zip(*arrays: np.ndarray, level: int = 1) -> bytes:
    import zstandard

    return zstandard.compress(b"".join(a.tobytes() for a in arrays), level)


def _unzip(blob: bytes, *kinds: tuple[str, int]) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.decompress(blob), 0, []
    for kind, n in kinds:
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


class Pack:
    """Documents end to end: bytes, starts and ids."""

    def __init__(self, row: dict) -> None:
        n = row["docs"]
        self.no = row["pack"]
        self.size, self.ids, self.nameless = _unzip(row["head"], ("<i8", n), ("<i8", n), ("u1", n))
        self.end = np.cumsum(self.size)
        self.start = self.end - self.size
        (self.data,) = _unzip(row["body"], ("u1", int(self.size.sum())))

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, hashes and documents of the anchors."""
        pos, value = [], []
        raw = np.concatenate([self.data, np.zeros(32, np.uint8)])
        n, step = len(self.data) - GRAM + 1, 1 << 17
        width = REACH + 1
        for at in range(0, max(0, n - width + 1), step):
            stop = min(n, at + step + 2 * width)  # windows that start in [at, at + step) and their neighbours
            lo = max(0, at - width)
            h = gram_hashes(raw, lo, stop - lo)
            least = _slide(h, width, np.minimum)
            most = _slide(least, width, np.maximum)
            hit = np.zeros(len(h), bool)
            hit[width - 1 : width - 1 + len(most)] = h[width - 1 : width - 1 + len(most)] == most
            # at the rims fewer windows cover a position
            for i in [*range(min(width - 1, len(h))), *range(max(width - 1, width - 1 + len(most)), len(h))]:
                cover = least[max(0, i - width + 1) : i + 1]
                hit[i] = len(cover) > 0 and h[i] == cover.max()
            i = np.flatnonzero(hit) + lo
            own = (i >= at) & ((i < at + step) | (at + step >= n - width + 1))
            pos.append(i[own])
            value.append(h[i[own] - lo])
        if not pos:
            return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
        pos, value = np.concatenate(pos), np.concatenate(value)
        doc = np.searchsorted(self.end, pos, side="right")
        inside = pos + GRAM <= self.end[doc]
        # anchors have the least hashes of their windows; mixed again they spread evenly over the ranges
        return pos[inside], (value[inside] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16), doc[inside]


def gram_hashes(raw: np.ndarray, at: int, n: int) -> np.ndarray:
    word = lambda k: np.ndarray((n,), "<u8", buffer=raw, offset=at + k, strides=(1,))
    h = word(0) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h += word(8)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    return h


def _slide(x: np.ndarray, width: int, op) -> np.ndarray:
    if len(x) < width:
        return x[:0]
    span = 1
    while span < width:
        step = min(span, width - span)
        x = op(x[:-step], x[step:])
        span += step
    return x


PACK = T.StructType([T.StructField("pack", T.LongType()), T.StructField("docs", T.LongType()), T.StructField("bytes", T.LongType()), T.StructField("head", T.BinaryType()), T.StructField("body", T.BinaryType())])
DEALT = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("pack", T.LongType()), T.StructField("n", T.LongType()), T.StructField("blob", T.BinaryType())])


def _arrow(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    kinds = [pa.binary() if isinstance(f.dataType, T.BinaryType) else pa.int64() for f in schema.fields]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)


def make_packs(batches):
    part, serial, texts, ids, size = TaskContext.get().partitionId(), 0, [], [], 0

    def flush():
        lengths = np.array([len(t) for t in texts], "<i8")
        body = np.frombuffer(b"".join(texts), np.uint8)
        return _arrow([(part << 24 | serial, len(texts), len(body), _zip(lengths, np.array([LAST if i is None else i for i in ids], "<i8"), np.array([i is None for i in ids], "u1")), _zip(body, level=4))], PACK)

    for batch in batches:
        for i, t in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            texts.append(t or b"")
            ids.append(i)
            size += len(texts[-1])
            if size >= PACK_BYTES:
                yield flush()
                serial, texts, ids, size = serial + 1, [], [], 0
    if texts:
        yield flush()


def _rows(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in batch.schema.names}


def range_of(value: np.ndarray, n_ranges: int) -> np.ndarray:
    """Of 48-bit hashes: their range of equal width."""
    return (value * np.uint64(n_ranges) >> np.uint64(48) if n_ranges < 1 << 16 else (value >> np.uint64(16)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


def runs_of(key: np.ndarray):
    """Bounds of the runs of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist() if len(key) else []
    return zip(edge, [*edge[1:], len(key)], strict=True)


def deal_hashes(n_ranges: int):
    """Pass 1, map: a pack's distinct anchor hashes by range; the top bit says whether two documents of it hold one."""

    def run(batches):
        for row in _rows(batches):
            pack = Pack(row)
            _, value, doc = pack.anchors()
            order = np.lexsort((doc, value))
            value, ids = value[order], pack.ids[doc[order]]
            if not len(value):
                continue
            first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            many = np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)
            value = value[first]
            bucket = range_of(value, n_ranges)
            out = []
            for a, b in runs_of(bucket):  # only the ranges that the pack has something for
                v, m = value[a:b], many[a:b]
                out.append((int(bucket[a]), pack.no, len(v), _zip(np.diff(v, prepend=v[:1]) | m.astype(np.uint64) << np.uint64(63), v[:1])))
            yield _arrow(out, DEALT)

    return run


def _whole_groups(batches, key: str):
    """Rows of sorted batches, group by group."""
    held, now = [], None
    for row in _rows(batches):
        if held and row[key] != now:
            yield now, held
            held = []
        now = row[key]
        held.append(row)
    if held:
        yield now, held


def meet_hashes(batches):
    """Pass 1, reduce: send to each pack its hashes that another document may hold."""
    for b, rows in _whole_groups(batches, "bucket"):
        values, many = [], []
        for r in rows:
            step, first = _unzip(r["blob"], ("<u8", r["n"]), ("<u8", 1))
            values.append(np.cumsum(step & np.uint64(2**63 - 1)) + first[0])
            many.append(step >> np.uint64(63) > 0)
        every = np.concatenate(values)
        distinct, place, count = np.unique(every, return_inverse=True, return_counts=True)
        again = count > 1
        np.logical_or.at(again, place, np.concatenate(many))
        out = []
        for r, v in zip(rows, values, strict=True):
            v = v[again[np.searchsorted(distinct, v)]]
            if len(v):
                out.append((b, r["pack"], len(v), _zip(v.astype("<u8"))))
        yield _arrow(out, DEALT)


#: A context: the bytes to the left of the anchor, then the suffix.
WIDTH = REACH + LENGTH


def repeated_contexts(row: dict):
    """Of a pack with its repeated hashes: the contexts to compare, and what is settled here.

    Returns (positions, ids, left, right, contexts) to compare and
    (positions, masks) settled.  Bit ``o`` of a mask says that the window that
    starts ``o`` bytes before the anchor goes.
    """
    pack = Pack(row)
    pos, value, doc = pack.anchors()
    known = np.sort(np.concatenate([_unzip(b["blob"], ("<u8", b["n"]))[0] for b in row["again"]]))
    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
    some = known[at] == value
    pos, doc = pos[some], doc[some]
    left = np.minimum(REACH, pos - pack.start[doc])
    right = np.minimum(LENGTH, pack.end[doc] - pos)
    some = left + right >= LENGTH
    pos, doc, left, right = pos[some], doc[some], left[some], right[some]
    raw = np.concatenate([np.zeros(REACH, np.uint8), pack.data, np.zeros(LENGTH, np.uint8)])
    context = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[pos] if len(pos) else np.empty((0, WIDTH), np.uint8)
    column = np.arange(WIDTH)
    context = context * ((column >= REACH - left[:, None]) & (column < REACH + right[:, None]))
    ids = pack.ids[doc]
    if not len(pos):
        return pack, pos, ids, left, right, context, pos, np.empty(0, np.uint64)
    # equal contexts within the pack: those of larger ids need no one else's word
    words = np.ascontiguousarray(np.pad(context, ((0, 0), (0, -WIDTH % 8)))).view("<u8")
    mixed = words @ (np.arange(words.shape[1], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C16) + np.uint64(0xC2B2AE3D27D4EB4F))
    mixed ^= mixed >> np.uint64(31)
    order = np.lexsort((ids, mixed))
    same = np.zeros(len(order), bool)
    same[1:] = (context[order[1:]] == context[order[:-1]]).all(axis=1) & (left[order[1:]] == left[order[:-1]]) & (right[order[1:]] == right[order[:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    later = np.zeros(len(order), bool)
    later[order] = ids[order] > ids[order[head]]
    mask = valid_offsets(left, right)
    return pack, pos[~later], ids[~later], left[~later], right[~later], context[~later], pos[later], mask[later]


def valid_offsets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    o = np.arange(REACH + 1)
    ok = (o <= left[:, None]) & (LENGTH - o <= right[:, None])
    return (ok.astype(np.uint64) << o.astype(np.uint64)).sum(axis=1, dtype=np.uint64)


def leading(context: np.ndarray) -> np.ndarray:
    """The suffixes' first ``GRAM`` bytes, as strings that sort like bytes."""
    return np.ascontiguousarray(context[:, REACH : REACH + GRAM]).view(">u8").astype(np.uint64)


def bucket_of(lead: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Ranges of the leading strings; ``splitters`` are sorted pairs of words."""
    a = np.searchsorted(splitters[:, 0], lead[:, 0], side="left")
    b = np.searchsorted(splitters[:, 0], lead[:, 0], side="right")
    tie = np.flatnonzero(a < b)  # equal first words: the second decides
    for i in tie.tolist():
        a[i] += np.searchsorted(splitters[a[i] : b[i], 1], lead[i, 1], side="right")
    return a


def sample_leads(most: int):
    def run(batches):
        for row in _rows(batches):
            lead = leading(repeated_contexts(row)[5])
            pick = lead[np.linspace(0, len(lead) - 1, min(most, len(lead))).astype(int)] if len(lead) else lead
            yield pa.RecordBatch.from_arrays([pa.array(pick[:, 0].view(np.int64)), pa.array(pick[:, 1].view(np.int64))], names=["a", "b"])

    return run


def split_leads(leads: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Splitters of ``n`` ranges from sampled leading strings, and the leads that are hot."""
    if not len(leads):
        return np.empty((0, 2), np.uint64), np.empty((0, 2), np.uint64)
    leads = leads[np.lexsort((leads[:, 1], leads[:, 0]))]
    distinct, count = np.unique(leads, axis=0, return_counts=True)
    hot = distinct[count > np.maximum(16, HOT * len(leads) / n)]
    rest = leads[~is_among(leads, hot)]
    splitters = np.unique(rest[np.linspace(0, len(rest) - 1, n + 1).astype(int)[1:-1]], axis=0) if len(rest) else hot[:0]
    return splitters, hot


def is_among(lead: np.ndarray, some: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lead), bool)
    for a, b in some.tolist():  # a few: each has its share of the sample
        out |= (lead[:, 0] == np.uint64(a)) & (lead[:, 1] == np.uint64(b))
    return out


def mix_words(data: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of the bytes of each row."""
    words = np.ascontiguousarray(np.pad(data, ((0, 0), (0, -data.shape[1] % 8)))).view("<u8")
    h = np.full(len(words), seed, np.uint64)
    for j in range(words.shape[1]):
        h = (h ^ words[:, j]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def hot_windows(pos, ids, left, right, context) -> tuple:
    """Single windows of contexts with a hot lead: (offset, pos, id, window) to compare, and (pos, mask) settled."""
    parts, done = [], []
    for o in range(REACH + 1):
        at = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if not len(at):
            continue
        window = np.ascontiguousarray(context[at, REACH - o : REACH - o + LENGTH])
        order = np.lexsort((ids[at], mix_words(window)))
        at, window = at[order], window[order]
        new = np.concatenate([[True], (window[1:] != window[:-1]).any(axis=1)])
        least = np.minimum.reduceat(ids[at], np.flatnonzero(new))[np.cumsum(new) - 1]
        later = ids[at] > least
        done.append((pos[at[later]], np.full(int(later.sum()), 1 << o, np.uint64)))
        at, window = at[~later], window[~later]
        parts.append((np.full(len(at), o, "u1"), pos[at], ids[at], window))
    if not parts:
        return np.empty(0, "u1"), pos[:0], ids[:0], np.empty((0, LENGTH), np.uint8), pos[:0], np.empty(0, np.uint64)
    return (*(np.concatenate(x) for x in zip(*parts, strict=True)), *(np.concatenate(x) for x in zip(*done, strict=True)))


def deal_suffixes(splitters: np.ndarray, hot: np.ndarray, parts: int, ranges: int):
    """Pass 2: contexts by bucket, windows of hot leads by bucket from ``ranges`` times two on; -1 - n holds what is settled already."""

    def run(batches):
        for row in _rows(batches):
            pack, pos, ids, left, right, context, done, masks = repeated_contexts(row)
            lead, out = leading(context), []
            often = is_among(lead, hot)
            if often.any():
                offset, p, i, window, more, mask = hot_windows(pos[often], ids[often], left[often], right[often], context[often])
                done, masks = np.concatenate([done, more]), np.concatenate([masks, mask])
                bucket = HOT_BUCKETS + (mix_words(window, 1) % np.uint64(ranges)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                for a, b in runs_of(bucket[order]):
                    at = order[a:b]
                    out.append((int(bucket[at[0]]), pack.no, len(at), _zip(i[at], p[at].astype("<u4"), offset[at], window[at], level=4)))
                pos, ids, left, right, context, lead = (x[~often] for x in (pos, ids, left, right, context, lead))
            if len(done):
                out.append((-1 - pack.no, pack.no, len(done), _zip(done.astype("<u4"), masks)))
            if len(pos):
                bucket = bucket_of(lead, splitters) * parts
                if parts > 1:
                    bucket += (mix_words(context[:, REACH : REACH + GRAM]) >> np.uint64(33)).astype(np.int64) % parts
                order = np.lexsort((lead[:, 1], lead[:, 0], bucket))  # in this order neighbours compress each other
                for a, b in runs_of(bucket[order]):
                    i = order[a:b]
                    out.append((int(bucket[i[0]]), pack.no, len(i), _zip(ids[i], pos[i].astype("<u4"), left[i].astype("u1"), right[i].astype("u1"), context[i], level=4)))
            yield _arrow(out, DEALT)

    return run


#: Numbers of buckets from here on hold windows of hot leads.
HOT_BUCKETS = 1 << 40
#: Runs of suffixes of which quicksort makes an end.
SMALL = 512
#: Factor of the running hash of the bytes to the left.
STEP = 0x100000001B3


def multikey_order(words: np.ndarray) -> np.ndarray:
    """Order of the rows of (n, m) words by multikey quicksort: three parts by one word, of which the middle goes on to the next."""
    order, todo = np.arange(len(words)), [(0, len(words), 0)]
    while todo:
        lo, hi, d = todo.pop()
        if hi - lo < 2 or d == words.shape[1]:
            continue
        some = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = some[np.lexsort(words[some, d:].T[::-1])]
            continue
        w = words[some, d]
        pivot = np.sort(w[np.linspace(0, len(w) - 1, 9).astype(int)])[4]
        less, more = w < pivot, w > pivot
        a, c = int(less.sum()), int(more.sum())
        order[lo:hi] = np.concatenate([some[less], some[~(less | more)], some[more]])
        todo += [(lo, lo + a, d), (lo + a, hi - c, d + 1), (hi - c, hi, d)]
    return order


def compare_windows(ids: np.ndarray, offset: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Masks of whole windows that a smaller id holds too."""
    order = multikey_order(np.ascontiguousarray(np.pad(window, ((0, 0), (0, -LENGTH % 8)))).view(">u8").astype(np.uint64))
    new = np.concatenate([[True], (window[order[1:]] != window[order[:-1]]).any(axis=1)])
    least = np.empty(len(ids), np.int64)
    least[order] = np.minimum.reduceat(ids[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    return np.where(ids > least, np.uint64(1) << offset.astype(np.uint64), np.uint64(0))


def compare(ids: np.ndarray, left: np.ndarray, right: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Pass 3 for one bucket: masks of the windows that a smaller id holds too."""
    n = len(ids)
    suffix = context[:, REACH:]
    order = multikey_order(np.ascontiguousarray(np.pad(suffix, ((0, 0), (0, -LENGTH % 8)))).view(">u8").astype(np.uint64))
    ids, left, right, context = ids[order], left[order].astype(int), right[order].astype(int), context[order]
    suffix = context[:, REACH:]
    differ = suffix[1:] != suffix[:-1]
    common = np.concatenate([[0], np.where(differ.any(axis=1), differ.argmax(axis=1), LENGTH)])
    mask, behind = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for o in range(REACH + 1):
        if o:
            behind = (behind ^ context[:, REACH - o]) * np.uint64(STEP) + np.uint64(o)
        run = np.cumsum(common < LENGTH - o)
        at = np.flatnonzero((left >= o) & (right >= LENGTH - o))
        if len(at) < 2:
            continue
        r, b = run[at], behind[at]
        lone = np.concatenate([[True], r[1:] != r[:-1]]) & np.concatenate([r[1:] != r[:-1], [True]])
        at = at[~lone]
        if len(at) < 2:
            continue
        by = np.lexsort((behind[at], run[at])) if o else np.arange(len(at))
        at = at[by]
        new = np.concatenate([[True], (run[at[1:]] != run[at[:-1]]) | (behind[at[1:]] != behind[at[:-1]])])
        if o:  # equal hashes of the bytes to the left: the bytes themselves decide
            apart = ~new[1:] & (context[at[1:], REACH - o : REACH] != context[at[:-1], REACH - o : REACH]).any(axis=1)
            if apart.any():
                left_bytes = context[at, REACH - o : REACH]
                by = np.lexsort((*left_bytes.T[::-1], run[at]))
                at, left_bytes = at[by], left_bytes[by]
                new = np.concatenate([[True], (run[at[1:]] != run[at[:-1]]) | (left_bytes[1:] != left_bytes[:-1]).any(axis=1)])
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(ids[at], first)[np.cumsum(new) - 1]
        mask[at[ids[at] > least]] |= np.uint64(1 << o)
    out = np.empty(n, np.uint64)
    out[order] = mask
    return out


def compare_buckets(batches):
    """Pass 3: sort each bucket, send the masks back to the packs."""
    for bucket, rows in _whole_groups(batches, "bucket"):
        if bucket < 0:
            yield _arrow([(bucket, r["pack"], r["n"], r["blob"]) for r in rows], DEALT)
            continue
        if bucket >= HOT_BUCKETS:
            parts = [_unzip(r["blob"], ("<i8", r["n"]), ("<u4", r["n"]), ("u1", r["n"]), ("u1", r["n"] * LENGTH)) for r in rows]
            ids, pos, offset, window = (np.concatenate(x) for x in zip(*parts, strict=True))
            mask = compare_windows(ids, offset, window.reshape(-1, LENGTH))
        else:
            parts = [_unzip(r["blob"], ("<i8", r["n"]), ("<u4", r["n"]), ("u1", r["n"]), ("u1", r["n"]), ("u1", r["n"] * WIDTH)) for r in rows]
            ids, pos, left, right, context = (np.concatenate(x) for x in zip(*parts, strict=True))
            mask = compare(ids, left, right, context.reshape(-1, WIDTH))
        cut = np.cumsum([0, *[r["n"] for r in rows]])
        out = []
        for k, r in enumerate(rows):
            m, p = mask[cut[k] : cut[k + 1]], pos[cut[k] : cut[k + 1]]
            if (m > 0).any():
                out.append((bucket, r["pack"], int((m > 0).sum()), _zip(p[m > 0], m[m > 0])))
        yield _arrow(out, DEALT)


SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def cut_pack(row: dict) -> pa.RecordBatch:
    """A pack's documents with the removed spans and the bytes that stay."""
    pack = Pack(row)
    gone = np.zeros(len(pack.data) + 1, np.int32)
    for r in row["again"] or []:
        pos, mask = _unzip(r["blob"], ("<u4", r["n"]), ("<u8", r["n"]))
        for o in range(REACH + 1):
            p = pos[mask >> np.uint64(o) & np.uint64(1) > 0].astype(np.int64) - o
            np.add.at(gone, p, 1)
            np.add.at(gone, p + LENGTH, -1)
    gone = np.cumsum(gone[:-1]) > 0
    spans, kept = [], []
    for a, b in zip(pack.start.tolist(), pack.end.tolist(), strict=True):
        here = gone[a:b]
        turn = np.flatnonzero(np.diff(here, prepend=False, append=False))
        spans.append([{"start": int(s), "end": int(e)} for s, e in zip(turn[::2], turn[1::2], strict=True)])
        kept.append(pack.data[a:b][~here].tobytes() if len(turn) else pack.data[a:b].tobytes())
    ids = [None if no else i for i, no in zip(pack.ids.tolist(), pack.nameless.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(pack.size), pa.array(spans, SPAN), pa.array(kept, pa.binary())], names=["id", "n_bytes", "spans", "kept"])


def remove_repeats(df: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_bytes, spans, kept): the removed byte spans and the bytes that stay, per document."""
    spark = df.sparkSession
    ship_package(spark)
    packs = materialize(df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(make_packs, PACK), "packs")
    total = packs.agg(F.sum("bytes"), F.count("*")).first()
    ranges = max(LEAST_RANGES, -(-(total[0] or 0) // RANGE_BYTES))

    def by_bucket(rows, work):
        return rows.repartition(ranges, "bucket").sortWithinPartitions("bucket").mapInArrow(work, DEALT)

    def with_packs(rows, how):
        again = rows.groupBy("pack").agg(F.collect_list(F.struct("n", "blob")).alias("again"))  # one row for each range at most
        return packs.join(again, "pack", how)

    again = materialize(by_bucket(packs.mapInArrow(deal_hashes(ranges), DEALT), meet_hashes), "again")
    release(spark)
    held = with_packs(again, "inner")
    n_splitters = min(ranges, MOST_SPLITTERS)
    parts = -(-ranges // n_splitters)
    few = max(1, total[1] // SAMPLE_PACKS)  # about one pack in so many gives splitters
    some = held.where(F.pmod(F.xxhash64("pack"), F.lit(few)) == 0)
    most = SAMPLE * n_splitters  # bounded, as splitters are
    leads = some.mapInArrow(sample_leads(max(1, most // SAMPLE_PACKS)), "a long, b long").limit(most).toPandas().to_numpy(np.int64).view(np.uint64)
    splitters, hot = split_leads(leads, n_splitters)
    masks = materialize(by_bucket(held.mapInArrow(deal_suffixes(splitters, hot, parts, ranges), DEALT), compare_buckets), "masks")
    del held, again
    release(spark)

    def cut(batches):
        for row in _rows(batches):
            yield cut_pack(row)

    return with_packs(masks, "left").mapInArrow(cut, "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary").withColumnRenamed("id", id_col)
