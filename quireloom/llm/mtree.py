"""Exact top-k search by inner product, best first over an M-tree.

Inner products become distances: with one more component ``sqrt(M^2 - |x|^2)``
for each vector ``x`` (``M`` the largest norm) and 0 for a query, the nearest
vectors are those of the largest products.  The tree has three levels of nodes:

* routing objects at the top, a bounded sample; every vector goes to its nearest;
* rings of a routing object's vectors by parent distance, each a group in shared
  storage with its covering and its inner radius;
* pages within a group, around routing objects of their own, with covering
  radii and with their distance to the object above them; entries of a page
  keep their distance to its object.

A query first searches the group where its own vector lies, which gives it a
k-th best score.  Then blocks of queries descend: the top level says which
routing objects may hold better vectors, a join with the rings of those says
which groups may, and only these meet the block.  Within a group, stored
distances rule out pages before the distance to their object is computed, pages
are visited in the order of their bounds, and the stored distances of entries
rule out entries.  Bounds are widened by more than rounding can move them.

Scores are exact integers: by floating point while no sum can pass 2^53, by
64-bit integers while none can pass 2^63, else by Python's, and then a score
beyond 64 bits counts as the nearest 64-bit integer.

Of equal vectors only the rows with the ``k + 1`` smallest ids can be among the
``k`` best of any query, so a group of copies is that many rows at most in the
tree.  Sizes of groups, pages and blocks are fixed, whatever the partitions.
Joins of queries, blocks and groups are merges: what these take in memory is
many times their files, by which Spark would have the driver broadcast them.

Defined results: vectors that are null or have null or non-finite components
take no part, as queries or candidates, nor do those whose scaled components are
beyond double precision's range; an empty vector scores 0 with all; rows without
an id take no part; repeated rows are candidates of their own, and a query's own
row is every row with its id; unequal lengths compare as if filled up with
zeros; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quireloom.llm.common import table_groups
from quireloom.llm.vectors import is_whole, matrix, same_width
from quireloom.session import materialize, ship_package

#: Vectors of a page, of a group (about), queries of a block, most routing objects and rings of one.
PAGE, GROUP, BLOCK, MOST_ROUTES, MOST_RINGS = 256, 8192, 256, 512, 256
#: Products of norms up to which sums are exact in doubles and in 64-bit integers, norms up to which distances are.
IN_DOUBLE, IN_LONG, IN_RANGE = 2.0**52, 2.0**62, 1e150
LEAST, MOST = -(2**63) + 1, 2**63 - 1


def pack(v: np.ndarray) -> list[bytes]:
    """Rows of integers held as doubles, one byte string each; equal vectors have equal strings."""
    small = (np.abs(v) < 2**31).all(axis=1)
    narrow, out = np.where(small[:, None], v, 0).astype("<i4"), []
    for i, s in enumerate(small.tolist()):
        raw, size = (narrow[i].tobytes(), 4) if s else (v[i].astype("<f8").tobytes(), 8)
        raw = raw.rstrip(b"\0")  # zeros at the end do not count
        out.append((b"4" if s else b"8") + raw + b"\0" * (-len(raw) % size))
    return out


def unpack(column, width: int) -> np.ndarray:
    raw = column.to_pylist()
    out = np.zeros((len(raw), width))
    for i, b in enumerate(raw):
        x = np.frombuffer(b, "<i4" if b[:1] == b"4" else "<f8", offset=1)
        out[i, : len(x)] = x
    return out


def whole_bytes(v: np.ndarray) -> bytes:
    return v.astype("<i4" if (np.abs(v) < 2**31).all() else "<f8").tobytes()


def whole_matrix(raw: bytes, n: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, "<i4" if len(raw) == 4 * n * width else "<f8").reshape(n, width).astype(np.float64)


def distances(x: np.ndarray, y: np.ndarray, top: float, query: bool) -> np.ndarray:
    """From each of ``x`` to each of ``y``, with the additional component."""
    x, y = same_width(x, y)
    own, other = (x * x).sum(axis=1), (y * y).sum(axis=1)
    extra = 0 if query else np.sqrt(np.maximum(0, top - own))[:, None]
    gap = extra - np.sqrt(np.maximum(0, top - other))[None, :]
    return np.nan_to_num(np.sqrt(np.maximum(0, own[:, None] + other[None, :] - 2 * (x @ y.T) + gap * gap)), posinf=0)


def most_product(base: np.ndarray, bound: np.ndarray, top: float) -> np.ndarray:
    """The largest product with a query (``base = |q|^2 + top``) of what is ``bound`` away at least."""
    if top > IN_RANGE**2:
        return np.full(bound.shape, np.inf)
    safe = np.maximum(0, bound - 1e-6 * np.sqrt(base + 1)[:, None])
    return (base[:, None] - safe * safe) / 2 + 1e-9 * (base[:, None] + 1)


def exact_products(q: np.ndarray, x: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Integer products; those that are surely below ``least`` may be any lower number."""
    reach = np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(x, axis=1).max(initial=0)
    if reach < IN_DOUBLE:
        return (q @ x.T).astype(np.int64)
    if reach < IN_LONG:
        return q.astype(np.int64) @ x.astype(np.int64).T
    with np.errstate(over="ignore", invalid="ignore"):
        near = q @ x.T
        error = np.linalg.norm(q, axis=1)[:, None] * np.linalg.norm(x, axis=1)[None, :] * (q.shape[1] + 2) * 2.0**-50
        some = ~(near + error < least[:, None]) | (least <= LEAST)[:, None]
    out = np.full(near.shape, LEAST - 1, np.int64)
    left, right = [[int(c) for c in row] for row in q], {}
    for i, j in zip(*np.nonzero(some), strict=True):
        if j not in right:
            right[j] = [int(c) for c in x[j]]
        out[i, j] = min(MOST, max(LEAST, sum(a * b for a, b in zip(left[i], right[j], strict=True))))
    return out


class Best:
    """The k best (score, id) of each query of a block."""

    def __init__(self, own: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.own, self.k, self.least = own, k, floor.copy()
        self.score = [np.empty(0, np.int64) for _ in own]
        self.ids = [np.empty(0, np.int64) for _ in own]

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        some = (score >= self.least[i]) & (ids != self.own[i])
        if not some.any():
            return
        score, ids = np.concatenate([self.score[i], score[some]]), np.concatenate([self.ids[i], ids[some]])
        if len(score) > self.k:
            order = np.lexsort((ids, -score))[: self.k]
            score, ids = score[order], ids[order]
        self.score[i], self.ids[i] = score, ids
        if len(score) >= self.k:
            self.least[i] = max(self.least[i], score.min())


class Group:
    """A group as it is stored: pages, their routing objects and all stored distances."""

    def __init__(self, row: dict) -> None:
        n, width = row["n"], row["width"]
        self.ids, self.parent = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["parent"], "<f8")
        self.x = whole_matrix(row["x"], n, width)
        self.above = np.frombuffer(row["above"], "<f8")  # of each page's object to the routing object of the group
        self.objects = whole_matrix(row["objects"], len(self.above), width)
        self.page, self.cut = np.array(row["page"]), np.array(row["cut"])
        self.inner, self.outer = self.parent[self.cut[:-1]], self.parent[self.cut[1:] - 1]


def search(q: np.ndarray, far: np.ndarray, best: Best, group: Group, top: float) -> None:
    """Best-first search of all queries of a block in a group; ``far`` is their distance to its routing object."""
    q, objects = same_width(q, group.objects)
    base = (q * q).sum(axis=1) + top  # |q - x|^2 = base - 2 <q, x>
    cover = np.zeros(len(objects))
    np.maximum.at(cover, group.page, group.outer)
    stored = np.abs(far[:, None] - group.above[None, :]) - cover[None, :]
    open_ = (most_product(base, np.maximum(0, stored), top) >= best.least[:, None]).any(axis=0)
    if not open_.any():
        return
    d = np.zeros((len(q), len(objects)))
    d[:, open_] = distances(q, objects[open_], top, query=True)
    pages = np.flatnonzero(open_[group.page])
    to = d[:, group.page[pages]]
    most = most_product(base, np.maximum(0, np.maximum(to - group.outer[pages], group.inner[pages] - to)), top)
    order = np.argsort(-most, axis=1, kind="stable")
    active = np.arange(len(q))
    for step in range(len(pages)):
        at = order[active, step]
        go = most[active, at] >= best.least[active]
        active, at = active[go], at[go]
        if not len(active):
            return
        for p in np.unique(at):
            who, low, high = active[at == p], group.cut[pages[p]], group.cut[pages[p] + 1]
            if top <= IN_RANGE**2:
                # entries whose stored distance leaves them no chance with any of these queries are not computed
                margin = 1e-6 * np.sqrt(base[who] + 1)
                reach = np.sqrt(np.maximum(0, base[who] - 2.0 * best.least[who]) + 4e-9 * (base[who] + 1)) + margin
                parent = group.parent[low:high]
                low, high = low + np.searchsorted(parent, (to[who, p] - reach - margin).min()), low + np.searchsorted(parent, (to[who, p] + reach + margin).max(), side="right")
            if low < high:
                score = exact_products(q[who], group.x[low:high], best.least[who])
                for row, i in enumerate(who):
                    best.add(i, score[row], group.ids[low:high])


PLACED = "id long, x binary, route int, parent double"
GROUPED = "id long, x binary, route int, parent double, gid long"
GROUP_ROW = "gid long, route int, near double, wide double, n int, width int, ids binary, parent binary, x binary, above binary, objects binary, page array<int>, cut array<int>"
BLOCK_ROW = "home long, size int, width int, ids binary, least binary, q binary"
FOUND = "query_id long, vec_id long, score long"


def record(schema: str, *columns) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64())}
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def place(rows: DataFrame, routes: np.ndarray, top: float, width: int) -> DataFrame:
    """Rows (id, x) with their nearest routing object and the distance to it."""

    def run(batches):
        for t in batches:
            if t.num_rows:
                d = distances(unpack(t.column("x"), width), routes, top, query=False)
                near = d.argmin(axis=1)
                yield record(PLACED, t.column("id"), t.column("x"), near.astype(np.int32), d[np.arange(len(d)), near])

    return rows.mapInArrow(run, PLACED)


def ring_bounds(placed: DataFrame) -> dict[int, np.ndarray]:
    """Inner bounds of the rings of each routing object: ``MOST_ROUTES`` rows of ``MOST_RINGS`` at most."""
    shares = [j / MOST_RINGS for j in range(1, MOST_RINGS)]
    rows = placed.groupBy("route").agg(F.count("*").alias("n"), F.percentile_approx("parent", shares, 4 * MOST_RINGS).alias("at")).collect()
    out = {}
    for r in rows:
        rings = min(MOST_RINGS, -(-r["n"] // GROUP))
        out[r["route"]] = np.unique([r["at"][j * MOST_RINGS // rings - 1] for j in range(1, rings)])
    return out


def assign(placed: DataFrame, bounds: dict[int, np.ndarray], tiles: dict[int, int]) -> DataFrame:
    """Placed rows with their group: routing object, ring and, of rings with too many rows, tile."""

    def run(batches):
        for t in batches:
            route, parent, ids = (t.column(c).to_numpy() for c in ("route", "parent", "id"))
            gid = route.astype(np.int64) << 40
            for r in np.unique(route):
                of = route == r
                gid[of] += np.searchsorted(bounds.get(int(r), np.empty(0)), parent[of], side="left").astype(np.int64) << 24
            for g in np.unique(gid):
                if (n := tiles.get(int(g), 1)) > 1:
                    of = gid == g
                    gid[of] += ((ids[of].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
            yield record(GROUPED, t.column("id"), t.column("x"), t.column("route"), t.column("parent"), gid)

    return placed.mapInArrow(run, GROUPED)


def build(assigned: DataFrame, top: float, width: int) -> DataFrame:
    """The groups, one row each."""

    def fill(batches):
        for (gid,), t in table_groups(batches, ["gid"]):
            x, ids, ring = unpack(t.column("x"), width), t.column("id").to_numpy(), t.column("parent").to_numpy()
            pick = np.unique(np.linspace(0, len(x) - 1, -(-len(x) // PAGE)).astype(int))
            d = distances(x, x[pick], top, query=False)
            near = d.argmin(axis=1)
            own = d[np.arange(len(x)), near]
            order = np.lexsort((ids, own, near))
            near, own = near[order], own[order]
            starts = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]]))
            cut = [c for a, b in zip(starts, [*starts[1:], len(near)], strict=True) for c in range(a, b, PAGE)]
            one = lambda v: [v]
            yield record(GROUP_ROW, one(gid), one(gid >> 40), one(ring.min()), one(ring.max()), one(len(x)), one(width), one(ids[order].astype("<i8").tobytes()), one(own.astype("<f8").tobytes()), one(whole_bytes(x[order])), one(ring[pick].astype("<f8").tobytes()), one(whole_bytes(x[pick])), one(near[cut].tolist()), one([*cut, len(x)]))

    return assigned.repartition("gid").sortWithinPartitions("gid", "parent", "id").mapInArrow(fill, GROUP_ROW)


def query_blocks(rows: DataFrame, width: int) -> DataFrame:
    """Blocks of queries with one home group, from rows (id, x, gid, least); a group with very many is cut by hash."""
    crowd = rows.groupBy("gid").agg(F.count("*").alias("crowd")).where(F.col("crowd") > 64 * BLOCK)
    parts = F.ceil(F.coalesce("crowd", F.lit(1)) / F.lit(64 * BLOCK))
    rows = rows.join(crowd, "gid", "left").withColumn("part", F.pmod(F.xxhash64(F.lit(3), "id"), parts).cast("int")).drop("crowd")

    def fill(batches):
        for (gid, _), t in table_groups(batches, ["gid", "part"]):
            for i in range(0, len(t), BLOCK):
                s = t.slice(i, BLOCK)
                x = unpack(s.column("x"), width)
                yield record(BLOCK_ROW, [gid], [len(s)], [width], [s.column("id").to_numpy().astype("<i8").tobytes()], [s.column("least").to_numpy().astype("<i8").tobytes()], [whole_bytes(x)])

    return rows.repartition("gid", "part").sortWithinPartitions("gid", "part", "id").mapInArrow(fill, BLOCK_ROW)


def visits(asked: DataFrame, groups: DataFrame, routes: np.ndarray, top: float, k: int) -> DataFrame:
    """The best of each group for the queries of each block that meets it, from blocks with ``gid``."""

    def run(batches):
        for t in batches:
            for i in range(t.num_rows):
                row = {c: t.column(c)[i].as_py() for c in t.schema.names}
                own, least = np.frombuffer(row["qids"], "<i8"), np.frombuffer(row["least"], "<i8")
                q = whole_matrix(row["q"], row["size"], row["width"])
                best = Best(own, least, k)
                far = distances(q, routes[row["route"]][None, :], top, query=True)[:, 0]
                search(q, far, best, Group(row), top)
                size = [len(s) for s in best.score]
                yield record(FOUND, np.repeat(own, size), np.concatenate(best.ids), np.concatenate(best.score))

    return asked.select("gid", F.col("ids").alias("qids"), "size", "least", "q").join(groups.hint("merge"), "gid").mapInArrow(run, FOUND)


def descend(blocks: DataFrame, directory: DataFrame, count: int, spans: dict[int, tuple[float, float]], routes: np.ndarray, top: float) -> DataFrame:
    """(no, gid): the groups that may hold something better for a query of a block."""
    some = np.array(sorted(spans))
    near, wide = (np.array([spans[r][i] for r in some.tolist()]) for i in range(2))
    schema = "no long, home long, route int, base binary, least binary, far binary"

    def at_top(batches):
        for t in batches:
            for i in range(t.num_rows):
                row = {c: t.column(c)[i].as_py() for c in ("no", "home", "size", "width", "least", "q")}
                q, least = whole_matrix(row["q"], row["size"], row["width"]), np.frombuffer(row["least"], "<i8")
                base = (q * q).sum(axis=1) + top
                d = distances(q, routes[some], top, query=True)
                go = np.flatnonzero((most_product(base, np.maximum(d - wide, near - d), top) >= least[:, None]).any(axis=0))
                n = len(go)
                yield record(schema, [row["no"]] * n, [row["home"]] * n, some[go].astype(np.int32), [base.tobytes()] * n, [row["least"]] * n, [d[:, g].tobytes() for g in go])

    def at_rings(batches):
        for t in batches:
            for i in range(t.num_rows):
                row = {c: t.column(c)[i].as_py() for c in t.schema.names}
                base, d, least = np.frombuffer(row["base"]), np.frombuffer(row["far"])[:, None], np.frombuffer(row["least"], "<i8")
                bound = np.maximum(d - np.array(row["wide"])[None, :], np.array(row["near"])[None, :] - d)
                go = (most_product(base, bound, top) >= least[:, None]).any(axis=0)
                gid = np.array(row["gids"], np.int64)[go]
                gid = gid[gid != row["home"]]
                yield record("no long, gid long", [row["no"]] * len(gid), gid)

    rings = directory.groupBy("route").agg(F.collect_list("gid").alias("gids"), F.collect_list("near").alias("near"), F.collect_list("wide").alias("wide"))
    # known small, unlike the blocks at their routes, whose estimate says nothing of how many routes a block meets
    rings = rings.hint("broadcast" if count <= MOST_ROUTES * MOST_RINGS else "merge")
    return blocks.mapInArrow(at_top, schema).join(rings, "route").mapInArrow(at_rings, "no long, gid long")


def top_k(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", every: int = 20, k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each vector whose id ``every`` divides."""
    spark = df.sparkSession
    ship_package(spark)
    raw = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null")
    raw = raw.where(F.coalesce(F.col("v").isNotNull() & ((F.size("v") == 0) | is_whole(F.col("v"))), F.lit(False)))
    schema = "id long, x binary, norm double, width int"

    def quantize(batches):
        for t in batches:
            with np.errstate(over="ignore"):
                x = np.floor(matrix(t.column("v")) * scale) + 0.0
            ok = np.isfinite(x).all(axis=1)
            x = x[ok]
            with np.errstate(over="ignore"):
                yield record(schema, t.column("id").to_numpy()[ok], pack(x), (x * x).sum(axis=1), np.full(len(x), x.shape[1], np.int32))

    rows = materialize(raw.mapInArrow(quantize, schema), "vectors")
    n, top, width = rows.agg(F.count("*"), F.max("norm"), F.max("width")).first()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(1, width)
    # of equal vectors: the k + 1 smallest ids, and of an id k rows
    once = Window.partitionBy("x", "id").orderBy("id")
    least_ids = Window.partitionBy("x").orderBy("id")
    kept = rows.select("id", "x").withColumn("no", F.row_number().over(once)).where(F.col("no") <= k).drop("no")
    kept = kept.withColumn("no", F.dense_rank().over(least_ids)).where(F.col("no") <= k + 1).drop("no")
    some = rows.orderBy(F.xxhash64(F.lit(9), "id"), "id").limit(min(MOST_ROUTES, max(1, n // (4 * PAGE)))).select("x")
    routes = np.unique(unpack(some.toArrow().column("x"), width), axis=0)  # at most MOST_ROUTES rows

    placed = materialize(place(kept, routes, top, width), "placed")
    bounds, tiles = {}, {}
    if n > GROUP:  # otherwise no routing object has more than one ring
        bounds = ring_bounds(placed)
        crowded = assign(placed, bounds, {}).groupBy("gid").count().where(F.col("count") > 2 * GROUP).collect()  # at most MOST_ROUTES * MOST_RINGS rows
        tiles = {r["gid"]: -(-r["count"] // GROUP) for r in crowded}
    groups = materialize(build(assign(placed, bounds, tiles), top, width), "groups")
    directory = groups.select("gid", "route", "near", "wide")
    tops = directory.groupBy("route").agg(F.min("near").alias("a"), F.max("wide").alias("b"), F.count("*").alias("n")).collect()  # MOST_ROUTES rows
    spans = {r["route"]: (r["a"], r["b"]) for r in tops}

    queries = materialize(assign(place(rows.where(F.pmod("id", F.lit(every)) == 0).select("id", "x"), routes, top, width), bounds, tiles).select("id", "x", "gid"), "queries")
    at_home = query_blocks(queries.withColumn("least", F.lit(LEAST - 1).cast("long")), width).withColumn("gid", F.col("home"))
    found = visits(at_home, groups, routes, top, k)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    count = sum(r["n"] for r in tops)
    if count == 1:
        return ranked(found)
    found = materialize(found, "near")
    worst = found.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("least")).select("id", F.when(F.col("n") >= k, F.col("least")).alias("floor"))
    again = queries.join(worst.hint("merge"), "id", "left").select("id", "x", "gid", F.coalesce("floor", F.lit(LEAST - 1)).cast("long").alias("least"))
    blocks = materialize(query_blocks(again, width).withColumn("no", F.monotonically_increasing_id()), "blocks")
    asked = blocks.hint("merge").join(descend(blocks, directory, count, spans, routes, top), "no")
    return ranked(found.unionByName(visits(asked, groups, routes, top, k)))
