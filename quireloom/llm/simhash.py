"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints (in the similarity join: equal sets of shingles) collapse into
one node first, so a group of exact copies, however large, is one row.  Nodes meet by keys made of some of their bits.  For
the exact join the fingerprint is cut into ``r + c`` blocks for a radius ``r``:
two fingerprints within the radius agree on ``c`` whole blocks at least, so each
choice of ``c`` blocks is a table of keys and no link is lost.  ``c`` follows the
number of nodes, which keeps groups small.  Groups above ``GROUP`` nodes split
into tiles, so that no task holds more than two tiles of a group at a time.

Within a group the fingerprints stand vertically, one bit plane for each bit
position, 64 fingerprints to a word.  One exclusive-or compares a plane with a
query bit, or with the plane shifted to a neighbour, for all of them at once;
carry-save counters add up the differences, and a block is abandoned as soon
as every lane exceeds the radius.  Where a group has more links than members,
a spanning forest of them goes on: components need no more.

Defined results: a null or empty text has fingerprint zero, linked like any
other; texts shorter than a shingle count as one shingle; repeated rows repeat;
the component of rows without an id is the least id reachable, null if there is
none; an empty table gives an empty table; input columns named like outputs
give way to them.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireloom.llm.common import add_columns, table_groups
from quireloom.llm.components import components, forest
from quireloom.session import materialize, ship_package

WIDTH, SEED = 64, 42
ONES = np.uint64(0x0101010101010101)


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 of the word shingles of a text, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # both on ASCII alone
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else []
    flat, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    return [hash64(flat[a:b], SEED) for a, b in zip((end - size)[: len(words) - k + 1].tolist(), end[k - 1 :].tolist(), strict=True)]


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the bits set in over half of them.

    Eight bits are counted side by side in the bytes of a word, at most 255
    hashes at a time, so nothing overflows.
    """
    out = np.zeros(len(counts), np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    n = counts[some]
    begin = np.concatenate([[0], np.cumsum(n)[:-1]])
    parts = -(-n // 255)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    at = np.repeat(begin, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    total = np.zeros(len(some), np.uint64)
    for bit in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(bit)) & ONES, at)
        count = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            total |= (2 * count[:, byte] > n).astype(np.uint64) << np.uint64(8 * byte + bit)
    out[some] = total
    return out


def mixed(h: np.ndarray, i: int) -> np.ndarray:
    """The ``i``-th further hash of values that are hashes already."""
    if i:
        h = h + np.uint64(i * 0x9E3779B97F4A7C15 % 2**64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(31))
    return h


def fingerprints(df: DataFrame, text_col: str = "text", k: int = 4, keep_text: bool = True) -> DataFrame:
    """Add the fingerprint as a signed long, ``fp``."""

    def make():
        def kernel(batch):
            rows = [shingle_hashes(t, k) for t in batch.column(text_col).to_pylist()]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.fromiter((h for r in rows for h in r), np.uint64, int(counts.sum()))
            return [pa.array(majority(flat, counts).view(np.int64), pa.int64())]

        return kernel

    return add_columns(df, [T.StructField("fp", T.LongType())], make, by=text_col, drop=() if keep_text else (text_col,))


def set_prints(df: DataFrame, text_col: str, k: int, words: int) -> DataFrame:
    """Replace the text by ``node``, a hash of its set of shingles, and a fingerprint of ``words`` longs.

    The fingerprint is that of the set too: shingles count once, so that its
    bits differ as ``bit_share`` expects however often a passage is repeated.
    """

    def make():
        import xxhash

        def kernel(batch):
            rows = [np.unique(np.array(shingle_hashes(t, k), np.uint64)) for t in batch.column(text_col).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(r.tobytes(), SEED) for r in rows], np.uint64)
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            flat = np.concatenate(rows)
            return [pa.array(x.view(np.int64)) for x in (node, *[majority(mixed(flat, i), counts) for i in range(words)])]

        return kernel

    fields = [T.StructField(n, T.LongType()) for n in ("node", *[f"fp{i or ''}" for i in range(words)])]
    return add_columns(df, fields, make, by=text_col, drop=(text_col,))


#: Nodes of a group that are compared in one tile, and up to which group size
#: lanes are compared by shifts instead.
GROUP, SHIFT = 2048, 32


def planes_of(fp: np.ndarray) -> np.ndarray:
    """(n, words) fingerprints -> (bits, ceil(n / 64)) bit planes."""
    n = len(fp)
    bits = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    out = np.zeros((bits.shape[1], -(-n // 64) * 8), np.uint8)
    out[:, : packed.shape[0]] = packed.T
    return out.view(np.uint64)


def within(rows, alive: np.ndarray, radius: int) -> np.ndarray:
    """Lanes of ``alive`` with at most ``radius`` set bits over all of ``rows``.

    ``rows`` yields one word array for each bit position; counters are bit
    planes too, and what overflows them is over the radius.
    """
    depth = max(1, radius.bit_length())
    count = [np.zeros_like(alive) for _ in range(depth)]
    for k, carry in enumerate(rows):
        for c in count:
            carry, c[...] = c & carry, c ^ carry
            # the carry goes on to the next counter
        alive = alive & ~carry
        if k % 8 == 7:
            alive = alive & ~_over(count, radius)
            if not alive.any():
                return alive
    return alive & ~_over(count, radius)


def _over(count: list[np.ndarray], radius: int) -> np.ndarray:
    more, same = np.zeros_like(count[0]), np.full_like(count[0], ~np.uint64(0))
    for i in range(len(count) - 1, -1, -1):
        if radius >> i & 1:
            same = same & count[i]
        else:
            more = more | (same & count[i])
            same = same & ~count[i]
    return more


def lanes_of(words: np.ndarray) -> np.ndarray:
    """Positions of the set bits."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little"))


def shifted_pairs(fp: np.ndarray, group: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All close pairs within runs of ``group`` of at most ``SHIFT`` rows."""
    planes, left, right = planes_of(fp), [], []
    ahead = np.concatenate([planes[:, 1:], np.zeros((len(planes), 1), np.uint64)], axis=1)
    for d in range(1, SHIFT):
        same = np.zeros(planes.shape[1] * 64, bool)
        same[: len(group) - d] = group[:-d] == group[d:]
        if not same.any():
            break
        alive, a, b = np.packbits(same, bitorder="little").view(np.uint64), np.uint64(d), np.uint64(64 - d)
        i = lanes_of(within((p ^ ((p >> a) | (q << b)) for p, q in zip(planes, ahead, strict=True)), alive, radius))
        left.append(i)
        right.append(i + d)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def tile_blocks(one: np.ndarray, two: np.ndarray, radius: int, block: int = 256):
    """All close pairs between two sets of fingerprints, one block of queries after the other."""
    planes, n = planes_of(two), len(two)
    full = np.zeros(planes.shape[1] * 64, bool)
    full[:n] = True
    lanes = np.packbits(full, bitorder="little").view(np.uint64)
    for at in range(0, len(one), block):
        part = np.ascontiguousarray(one[at : at + block])
        bits = np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little")
        query = (np.uint64(0) - bits.astype(np.uint64)).T[:, :, None]
        alive = np.broadcast_to(lanes, (len(part), len(lanes)))
        hit = within((q ^ p for q, p in zip(query, planes, strict=True)), alive.copy(), radius)
        pos = lanes_of(np.ascontiguousarray(hit).reshape(-1))
        yield pos // (64 * len(lanes)) + at, pos % (64 * len(lanes))


def tile_pairs(one: np.ndarray, two: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All close pairs between two blocks of fingerprints."""
    left, right = zip(*tile_blocks(one, two, radius), strict=True)
    return np.concatenate(left), np.concatenate(right)


def group_links(ids: np.ndarray, fp: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of ``group``; where a run has two sides, between the sides only."""
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.concatenate([edge, [len(group)]]))
    small = np.repeat(size <= SHIFT, size)
    a, b = [], []
    at = np.flatnonzero(small & (np.repeat(size, size) > 1))
    if len(at):
        i, j = shifted_pairs(fp[at], group[at], radius)
        i, j = at[i], at[j]
        cross = (side[i] != side[j]) | (side[i] == 0)
        a.append(ids[i[cross]])
        b.append(ids[j[cross]])
    for s, n in zip(edge[size > SHIFT].tolist(), size[size > SHIFT].tolist(), strict=True):
        of, sides = slice(s, s + n), side[s : s + n]
        two = np.flatnonzero(sides == 2)
        one = np.flatnonzero(sides == 1) if len(two) else np.arange(n)
        rest = two if len(two) else one
        i = j = np.empty(0, int)
        for x, y in tile_blocks(fp[of][one], fp[of][rest], radius):
            x, y = one[x], rest[y]
            i, j = np.concatenate([i, x[x != y]]), np.concatenate([j, y[x != y]])
            if len(i) > n:  # never more than one block's pairs at a time
                i, j = forest(i, j, n)
        a.append(ids[of][i])
        b.append(ids[of][j])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.empty(0, np.int64), np.empty(0, np.int64))


def block_masks(n_nodes: int, radius: int, words: int = 1) -> list[list[int]]:
    """Bit masks (a long for each word) of which two close fingerprints agree on one at least."""
    width, choose = 64 * words, 1
    while choose < 4 and 2 ** (width * choose // (radius + choose)) < 4 * n_nodes:
        choose += 1
    parts = radius + choose
    cuts = [width * i // parts for i in range(parts + 1)]
    out = []
    for some in itertools.combinations(range(parts), choose):
        bits = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in some)
        out.append([int(np.uint64(bits >> (64 * w) & (2**64 - 1)).view(np.int64)) for w in range(words)])
    return out


def links(nodes: DataFrame, words: list[str], masks: list[list[int]], radius: int, id_col: str = "node") -> DataFrame:
    """(a, b) links of nodes within the radius that agree on some mask.

    All of them, but for groups with more links than members, which give a
    spanning forest of theirs.
    """
    ship_package(nodes.sparkSession)
    keys = [F.xxhash64(F.lit(i), *[F.col(w).bitwiseAND(F.lit(m)) for w, m in zip(words, mask, strict=True) if m]) for i, mask in enumerate(masks)]
    rows = nodes.select(id_col, *words, F.explode(F.array(*keys)).alias("key"))
    large = materialize(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > GROUP), "large-groups")
    some = not large.isEmpty()
    rows = rows.join(large, "key", "left") if some else rows
    tiles = F.ceil(F.coalesce(F.col("n"), F.lit(1)) / GROUP).cast("int") if some else F.lit(1)
    rows = rows.withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.col("tiles")).cast("int"))
    # a tile meets itself and each other tile of its group once; small groups are one tile
    other = F.explode(F.when(F.col("tiles") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.withColumn("other", other)
    rows = rows.select(id_col, *words, "key", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"))
    rows = rows.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")

    def run(batches):
        held: list = []

        def take(parts, last):
            ids, key, p, q, side = (np.concatenate([x[i] for x in parts]) for i in range(5))
            fp = np.concatenate([x[5] for x in parts])
            change = np.concatenate([[True], (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
            cut = len(ids) if last else int(np.flatnonzero(change)[-1])
            group = np.cumsum(change)
            a, b = group_links(ids[:cut], fp[:cut], group[:cut], side[:cut], radius) if cut else (ids[:0], ids[:0])
            return a, b, (ids[cut:], key[cut:], p[cut:], q[cut:], side[cut:], fp[cut:])

        def batch_of(a, b):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        size = 0
        for t in batches:
            col = lambda name: t.column(name).to_numpy(zero_copy_only=False)  # noqa: E731,B023
            held.append((col(id_col), col("key"), col("p"), col("q"), col("side"), np.stack([col(w).view(np.uint64) for w in words], axis=1)))
            size += t.num_rows
            if size >= 1 << 16:
                a, b, rest = take(held, False)
                held, size = [rest], len(rest[0])
                yield batch_of(a, b)
        if held:
            a, b, _ = take(held, True)
            yield batch_of(a, b)

    return rows.mapInArrow(run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def near_duplicates(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id) for each row of ``df``: the exact join at ``radius``."""
    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    prints = materialize(fingerprints(slim, "__text", k, keep_text=False), "fingerprints")
    nodes = materialize(prints.groupBy(F.col("fp").alias("node")).agg(F.min("__id").alias("least")), "simhash-nodes")
    masks = block_masks(nodes.count(), radius)
    root = components(links(nodes.withColumn("w0", F.col("node")), ["w0"], masks, radius))
    placed = nodes.join(root, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(least, "root").select(F.col("node").alias("fp"), "component_id")
    return prints.join(labels, "fp").select(F.col("__id").alias(id_col), "fp", "component_id")


#: The wide fingerprint of the similarity join: its words, the share of links at
#: the least similarity that its tables may miss, the radius in deviations.
WORDS, MISS, WIDE = 4, 0.001, 3.1
#: Texts of a tile of the exact check, tiles beyond which they hold more texts, and bytes of shingles that none holds more of.
TILE, FEW_TILES, TILE_BYTES = 128, 64, 16 << 20


def bit_share(similarity: float) -> float:
    """Share of bits in which texts of this shingle overlap are expected to differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def sampled_masks(n_nodes: int, similarity: float, words: int = WORDS, seed: int = 5) -> list[list[int]]:
    """Masks of sampled bits: enough of them that links at ``similarity`` agree on one."""
    bits = max(12, int(np.log2(max(2, n_nodes))) - 3)
    tables = int(np.ceil(np.log(MISS) / np.log(1 - (1 - bit_share(similarity)) ** bits)))
    rng, out = np.random.default_rng(seed), []
    for _ in range(tables):
        row = [0] * words
        for b in rng.choice(64 * words, bits, replace=False).tolist():
            row[b // 64] |= 1 << (b % 64)
        out.append([int(np.uint64(m).view(np.int64)) for m in row])
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; two empty ones are equal."""
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return same / (len(both) - same) if len(both) else 1.0


def confirmed(fp: np.ndarray, sets: list[np.ndarray], tile: np.ndarray, cross: bool, radius: int, similarity: float) -> tuple[list[int], list[int]]:
    """Links whose shingle sets do overlap enough, as far as they connect anything new.

    Candidates come from the bit-sliced comparison, one block of queries after
    the other; a pair that earlier links connect already is not looked at.
    """
    root = list(range(len(fp)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    left, right = [], []
    for i, j in tile_blocks(fp, fp, radius, 128):
        keep = (i < j) & ((tile[i] != tile[j]) if cross else True)
        for x, y in zip(i[keep].tolist(), j[keep].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q and overlap(sets[x], sets[y]) >= similarity:
                root[max(p, q)] = min(p, q)
                left.append(x)
                right.append(y)
    return left, right


def confirm(texts: DataFrame, words: list[str], radius: int, similarity: float, k: int) -> DataFrame:
    """(a, b) links within candidate groups, from rows (node, root, text, words)."""

    def sets_of():
        def kernel(batch):
            return [pa.array([np.unique(np.array(shingle_hashes(t, k), np.uint64)).tobytes() for t in batch.column("text").to_pylist()], pa.binary())]

        return kernel

    rows = add_columns(texts, [T.StructField("set", T.BinaryType())], sets_of, by="text", drop=("text",)).dropDuplicates(["node"])
    rows = materialize(rows, "shingle-sets")
    size = rows.groupBy("root").agg(F.count("*").alias("n"), F.sum(F.octet_length("set") + 64).alias("bytes"))
    tiles = F.least(F.greatest(F.lit(FEW_TILES), F.ceil(F.col("bytes") / TILE_BYTES)), F.ceil(F.col("n") / TILE)).cast("int")
    rows = rows.join(size, "root").where("n > 1").withColumn("tiles", tiles).drop("bytes").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("root", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "node", "set", *words)
    rows = rows.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q")

    def run(batches):
        for key, t in table_groups(batches, ["root", "p", "q"]):
            if len(t) > 1:
                node = t.column("node").to_numpy()
                fp = np.stack([t.column(w).to_numpy().view(np.uint64) for w in words], axis=1)
                sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
                i, j = confirmed(fp, sets, t.column("tile").to_numpy(), key[1] != key[2], radius, similarity)
                yield pa.RecordBatch.from_arrays([pa.array(node[i], pa.int64()), pa.array(node[j], pa.int64())], names=["a", "b"])

    return rows.mapInArrow(run, T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))


def _similar(df: DataFrame, text_col: str, id_col: str, k: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Rows (__id, node), and nodes (node, root, least, pick): ``pick`` names a row of the node.

    A node is one set of shingles; nodes of equal fingerprint are candidates like any others.
    """
    names = [f"fp{i or ''}" for i in range(WORDS)]
    slim = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.xxhash64(text_col).alias("__same"))
    prints = materialize(set_prints(slim, "__text", k, WORDS), "fingerprints")
    pick = F.min(F.struct(F.col("__id").isNull().alias("missing"), "__id", "__same"))
    nodes = materialize(prints.groupBy("node").agg(F.min("__id").alias("least"), pick.alias("pick"), *[F.first(n).alias(n) for n in names]), "simhash-nodes")
    share, width = bit_share(similarity), 64 * WORDS
    radius = int(width * share + WIDE * (width * share * (1 - share)) ** 0.5)
    root = components(links(nodes, names, sampled_masks(nodes.count(), similarity), radius))
    groups = root.unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    members = nodes.join(groups, "node").select("node", "root", F.col("pick.__id").alias("__pick"), F.col("pick.__same").alias("__pick_same"), *names)
    texts = df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    texts = members.join(texts, F.col("__id").eqNullSafe(F.col("__pick")) & (F.xxhash64("text") == F.col("__pick_same"))).select("node", "root", "text", *names)
    root = components(confirm(texts, names, radius, similarity, k))
    return prints.select("__id", "node"), nodes.join(root, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "pick")


def similar(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, component_id): groups of texts linked by word shingles that overlap by ``similarity``.

    256-bit fingerprints within a wide radius, met by tables of sampled bits,
    give candidate groups, which miss about ``MISS`` of the links at the least
    similarity and next to none above; within a group the shingle sets
    themselves decide.
    """
    prints, placed = _similar(df, text_col, id_col, k, similarity)
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = placed.join(least, "root").select("node", "component_id")
    return prints.join(labels, "node").select(F.col("__id").alias(id_col), "component_id")


def keep_one(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """``df`` with one row of each group of similar texts: that of the least id.

    Rows without an id come last in a group; of several rows with the least id
    that of the least text hash stays, of rows that are equal in both any one.
    """
    _, placed = _similar(df, text_col, id_col, k, similarity)
    kept = placed.groupBy("root").agg(F.min("pick").alias("pick")).select(F.col("pick.__id").alias("__kept"), F.col("pick.__same").alias("__same")).distinct()
    rows = df.join(kept, F.col(id_col).eqNullSafe(F.col("__kept")) & (F.xxhash64(text_col) == F.col("__same")), "left_semi")
    same = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(text_col)
    return rows.withColumn("__copy", F.row_number().over(same)).where("__copy = 1").drop("__copy")
