"""Embedding near-duplicates by NN-descent.

Equal vectors collapse into one node with a weight.  A neighbour graph starts
from random hyperplane blocks and is refined in rounds: along each edge (u, v),
``u`` meets the neighbours of ``v`` and keeps those nearer than its farthest
neighbour so far; reversed edges compete too.  These joins carry one-byte codes,
which is enough to rank neighbours.

A list whose last entry is near the threshold still is saturated.  It is enlarged
to ``LONG`` entries near the threshold within the same rounds.  Threshold edges
of all lists are then checked in double precision and stay as links.  Nodes that
are saturated at ``LONG`` lie in dense regions, where the links themselves number
the square of the nodes.  Two such nodes are compared in blocks instead:
connected dense nodes fall into cells around pivots and tiles of at most about
``TILE`` nodes, and two tiles meet unless the angles between their pivots and the
radii of their cells rule a link out.  Nothing is cut at ``LONG``: every list
entry counts, and what the lists of dense nodes lack, blocks find.

An audit compares a bounded sample of nodes, half of them with links and half
without, with all others exactly.  While the mean share of links found is below
``RECALL`` in either half, another graph from other hyperplanes joins the first.
If it stays below, a warning says so; below ``LEAST_RECALL`` the job fails.

Defined results: a vector that is null, empty, zero or has null or non-finite
components links with nothing; repeated rows count as vectors of their own; rows
without an id have the least id they reach as component, null if there is none,
and are not kept; vectors of unequal length are compared as if filled up with
zeros; lengths are taken after scaling, so components near the ends of double
precision's range do no harm; an empty table gives an empty table; the result
has the columns named below only.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quireloom.llm.common import table_groups
from quireloom.llm.components import components, forest
from quireloom.llm.vectors import is_whole, matrix, same_width
from quireloom.session import materialize, ship_package

#: Neighbours of a node at first and of a saturated one at last, blocks of the first graph, hyperplane tables, rounds.
LIST, LONG, BLOCK, TABLES, ROUNDS = 8, 64, 128, 4, 8
#: A round that adds fewer than this share of all edges near the threshold is the last.
STILL = 0.01
#: How far below the threshold an edge by codes may lie and still be checked.
SLACK = 0.03
#: Nodes of a tile, and most pivots of dense regions.
TILE, PIVOTS = 512, 256
#: Nodes of each half of the audit, the recall it asks for, tries, and the recall below which the job fails.
AUDIT, RECALL, TRIES, LEAST_RECALL = 256, 0.99, 3, 0.9

EDGES = "a long, b long, sim float"


def unit(v: np.ndarray) -> np.ndarray:
    """Rows at length one, whatever the size of their components."""
    most = np.abs(v).max(axis=1, keepdims=True, initial=0)
    v = v / np.where(most > 0, most, 1)
    norm = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(norm > 0, norm, 1)


def codes_of(v: np.ndarray) -> np.ndarray:
    return np.rint(unit(v) * 127).astype(np.int8)


def unpack(column: pa.Array, rows: int) -> np.ndarray:
    """Codes of a binary column, one row each."""
    raw = column.to_pylist()
    width = max(map(len, raw), default=0)
    return np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.int8).reshape(rows, width).astype(np.float32) / 127


def batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def first_graph(nodes: DataFrame, n_nodes: int, seed: int, size: int) -> DataFrame:
    """Edges between neighbours within blocks of similar vectors, from several sets of hyperplanes."""
    bits = max(1, min(40, int(np.log2(max(2, n_nodes / BLOCK)))))

    def place(batches):
        for t in batches:
            v = unit(matrix(t.column("vec")))
            for table in range(TABLES):
                planes = np.random.default_rng([seed, table]).standard_normal((v.shape[1], bits + 1))
                side = v @ planes
                key = ((side[:, :bits] > 0) << np.arange(bits)).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), table, np.int32)), pa.array(key.astype(np.int64)), pa.array(side[:, bits]), t.column("node"), t.column("code")], names=["table", "key", "side", "node", "code"])

    def meet(batches):
        for t in batches:
            node, code = t.column("node").to_numpy(), unpack(t.column("code"), t.num_rows)
            key, table = t.column("key").to_numpy(), t.column("table").to_numpy()
            cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (table[1:] != table[:-1])]))
            starts = [s for a, b in zip(cut, [*cut[1:], len(node)], strict=True) for s in range(a, b, BLOCK)]
            for a, b in zip(starts, [*starts[1:], len(node)], strict=True):
                if b - a < 2:
                    continue
                sim = code[a:b] @ code[a:b].T
                np.fill_diagonal(sim, -2)
                k = min(size, b - a - 1)
                best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
                yield batch(["a", "b", "sim"], np.repeat(node[a:b], k), node[a:b][best].reshape(-1), np.take_along_axis(sim, best, 1).reshape(-1).astype(np.float32))

    placed = nodes.select("node", "vec", "code").mapInArrow(place, "table int, key long, side double, node long, code binary")
    return placed.repartitionByRange("table", "key", "side").sortWithinPartitions("table", "key", "side", "node").mapInArrow(meet, EDGES)


def nearest(edges: DataFrame, size: int, least: float) -> DataFrame:
    """The ``size`` best distinct neighbours of each node, and more, up to ``LONG``, of ``least`` and above.

    ``old`` tells edges that were there before from new ones.
    """
    best = edges.groupBy("a", "b").agg(F.max("sim").alias("sim"), F.bool_or("old").alias("old"))
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))).where(F.col("rank") <= LONG)
    return ranked.where((F.col("rank") <= size) | (F.col("sim") >= least)).drop("rank")


def one_round(graph: DataFrame, codes: DataFrame, size: int, least: float) -> DataFrame:
    """Join nodes with their neighbours' neighbours: the old edges and new ones that beat the lists.

    A node whose list is saturated looks for edges of ``least`` and above until
    it has ``LONG`` of them.
    """
    ends = graph.join(codes.select(F.col("node").alias("b"), F.col("code").alias("b_code")), "b")
    # both uses below read this one aggregate, so that Spark can reuse its shuffle
    own = ends.groupBy("a").agg(F.collect_list(F.struct("b", "b_code", "sim")).alias("list"))  # at most LONG
    lists = own.withColumnRenamed("a", "via")
    # full at LONG: blocks will compare these, so their lists need not be the best
    near = F.size(F.filter("list", lambda e: e["sim"] >= least))
    last = F.array_min(F.transform("list", lambda e: e["sim"]))
    beat = F.when(near >= size, F.lit(least)).when(F.size("list") < size, F.lit(-1.0)).otherwise(last).cast("float")
    asks = own.where(near < LONG).join(codes.select(F.col("node").alias("a"), "code"), "a").select("a", "code", beat.alias("least"), F.transform("list", lambda e: e["b"]).alias("ends"))
    ask = asks.select("a", "code", "least", F.explode("ends").alias("via"))

    def compare(batches):
        for t in batches:
            for part in (t.slice(i, 1024) for i in range(0, t.num_rows, 1024)):
                a, code, beaten = part.column("a").to_numpy(), unpack(part.column("code"), part.num_rows), part.column("least").to_numpy()
                lists = part.column("list")
                n = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                flat = lists.flatten()
                b, other = flat.field("b").to_numpy(), unpack(flat.field("b_code"), len(flat))
                row = np.repeat(np.arange(len(a)), n)
                left, right = same_width(code, other)
                sim = np.einsum("ij,ij->i", left[row], right).astype(np.float32)
                new = (sim > beaten[row]) & (b != a[row])
                yield batch(["a", "b", "sim"], a[row][new], b[new], sim[new])

    new = ask.join(lists, "via").select("a", "code", "least", "list").mapInArrow(compare, EDGES)
    back = graph.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim")
    return nearest(graph.select("a", "b", "sim", F.lit(True).alias("old")).unionByName(back.unionByName(new).withColumn("old", F.lit(False))), size, least)


def saturated(graph: DataFrame, size: int, least: float) -> DataFrame:
    """(a): nodes whose list of ``size`` entries is full of edges at or above ``least``."""
    return graph.where(F.col("sim") >= least).groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") >= size).select("a")


def is_still(graph: DataFrame, least: float) -> bool:
    """Whether a round brought next to nothing near the threshold; edges far below it never come to rest."""
    new, every = graph.where(F.col("sim") >= least).agg(F.count(F.when(~F.col("old"), 1)), F.count("*")).first()
    return new <= STILL * every


def descend(nodes: DataFrame, n_nodes: int, seed: int, size: int, least: float) -> DataFrame:
    """The refined neighbour graph (a, b, sim by codes); saturated lists have up to ``LONG`` entries."""
    codes = nodes.select("node", "code")
    first = first_graph(nodes, n_nodes, seed, size).withColumn("old", F.lit(False))
    graph = materialize(nearest(first, size, least), "graph")
    for _ in range(ROUNDS):
        graph = materialize(one_round(graph, codes, size, least), "graph")
        if is_still(graph, least):
            break
    return graph.drop("old")


LINKS = "a long, links long, b long"


def checked(nodes: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """Both ends of the pairs (a, b) whose vectors do reach the threshold: rows (a, links, b), ``links`` the weight of ``b``."""
    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("vec").alias("u"), F.col("weight").alias("a_weight")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("vec").alias("v"), F.col("weight").alias("b_weight")), "b")

    def run(batches):
        for t in batches:
            u, v = same_width(unit(matrix(t.column("u"))), unit(matrix(t.column("v"))))
            ok = np.einsum("ij,ij->i", u, v) >= threshold
            a, b, a_weight, b_weight = (t.column(c).to_numpy()[ok] for c in ("a", "b", "a_weight", "b_weight"))
            yield batch(["a", "links", "b"], np.concatenate([a, b]), np.concatenate([b_weight, a_weight]), np.concatenate([b, a]))

    return both.select("a", "b", "a_weight", "b_weight", "u", "v").mapInArrow(run, LINKS)


def within_dense(nodes: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """Exact links between dense nodes (node, root): rows (a, links, b) with a link of ``a`` in ``b`` or none.

    ``links`` is the weight that ``a`` links to in a tile; the (a, b) are a
    spanning forest of the links found there.
    """
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-6
    rows = nodes.select("node", "weight", "vec").join(groups, "node")
    some = rows.orderBy(F.xxhash64(F.lit(7), "node"), "node").limit(PIVOTS).select("vec").toArrow()  # at most PIVOTS rows
    pivots = unit(matrix(some.column("vec").combine_chunks()))
    angle = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    schema = "root long, cell int, far double, node long, weight long, vec array<double>"

    def place(batches):
        for t in batches:
            if t.num_rows:
                v, p = same_width(unit(matrix(t.column("vec"))), pivots)
                cos = v @ p.T
                cell = cos.argmax(axis=1)
                far = np.arccos(np.clip(cos[np.arange(len(v)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([t.column("root"), pa.array(cell.astype(np.int32)), pa.array(far), t.column("node"), t.column("weight"), t.column("vec")], names=["root", "cell", "far", "node", "weight", "vec"])

    placed = materialize(rows.select("root", "node", "weight", "vec").mapInArrow(place, schema), "dense")
    cells = placed.groupBy("root", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far"))
    cells = cells.groupBy("root").agg(F.collect_list(F.struct("cell", "n", "far")).alias("cells"))  # at most PIVOTS of them

    def pairs(batches):
        for t in batches:
            for root, some in zip(t.column("root").to_pylist(), t.column("cells").to_pylist(), strict=True):
                at, far, tiles = np.array([c["cell"] for c in some]), np.array([c["far"] for c in some]), np.array([-(-c["n"] // TILE) for c in some])
                i, j = np.nonzero(angle[np.ix_(at, at)] - far[:, None] - far[None, :] <= reach)
                yield pa.RecordBatch.from_arrays([pa.array([root] * len(i), pa.int64()), pa.array(at[i], pa.int32()), pa.array(tiles[i], pa.int32()), pa.array(at[j], pa.int32()), pa.array(tiles[j], pa.int32())], names=["root", "cell", "tiles", "other", "others"])

    # a row goes to each pair of its tile with a tile of a cell in reach; the two tiles of a pair are ordered
    meeting = placed.join(cells.mapInArrow(pairs, "root long, cell int, tiles int, other int, others int"), ["root", "cell"])
    meeting = meeting.withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("long")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    own, other = F.col("cell").cast("long") * F.lit(1 << 32) + F.col("tile"), F.col("other").cast("long") * F.lit(1 << 32) + F.col("with")
    meeting = meeting.select("root", F.least(own, other).alias("p"), F.greatest(own, other).alias("q"), own.alias("own"), "node", "weight", "vec")
    meeting = meeting.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "node")

    def meet(key, t: pa.Table) -> tuple:
        node, weight, own = (t.column(c).to_numpy() for c in ("node", "weight", "own"))
        v = unit(matrix(t.column("vec").combine_chunks()))
        near = v @ v.T >= threshold
        np.fill_diagonal(near, False)
        if key[1] != key[2]:
            near &= own[:, None] != own[None, :]
        links = near @ weight
        i, j = np.nonzero(np.triu(near))
        a, b = forest(i, j, len(node)) if len(i) else (i, j)
        some = links > 0
        return pa.concat_arrays([pa.array(node[some]), pa.array(node[a])]), pa.concat_arrays([pa.array(links[some].astype(np.int64)), pa.array(np.zeros(len(a), np.int64))]), pa.concat_arrays([pa.nulls(int(some.sum()), pa.int64()), pa.array(node[b])])

    def run(batches):
        for key, t in table_groups(batches, ["root", "p", "q"], 2 * TILE):
            yield pa.RecordBatch.from_arrays(list(meet(key, t)), names=["a", "links", "b"])

    return meeting.mapInArrow(run, LINKS)


def links_of(nodes: DataFrame, graph: DataFrame, threshold: float) -> DataFrame:
    """Links from the lists, and those between dense nodes from blocks, as rows (a, links, b)."""
    near = graph.where(F.col("sim") >= threshold - SLACK).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    dense = materialize(saturated(graph, LONG, threshold - SLACK), "dense-nodes")
    if dense.isEmpty():
        pairs = near
    else:
        one, two = dense.withColumnRenamed("a", "x"), dense.withColumnRenamed("a", "y")
        marked = near.join(one, F.col("a") == F.col("x"), "left").join(two, F.col("b") == F.col("y"), "left")
        inside = F.col("x").isNotNull() & F.col("y").isNotNull()
        marked = materialize(marked.select("a", "b", inside.alias("inside")), "near")
        pairs = marked.where("not inside").select("a", "b")
        roots = components(marked.where("inside").select("a", "b"))
        groups = dense.select(F.col("a").alias("node")).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    from_lists = checked(nodes, pairs, threshold)
    if dense.isEmpty():
        return from_lists
    return from_lists.unionByName(within_dense(nodes, groups, threshold))


def audit_sample(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, linked, vec): at most ``AUDIT`` nodes with links and as many without."""
    linked = links.select(F.col("a").alias("node")).distinct().withColumn("linked", F.lit(True))
    known = nodes.join(linked, "node", "left").select("node", F.coalesce("linked", F.lit(False)).alias("linked"))
    order = [F.xxhash64(F.lit(3), "node"), "node"]
    some = known.where("linked").orderBy(*order).limit(AUDIT).unionByName(known.where("not linked").orderBy(*order).limit(AUDIT))
    return some.join(nodes.select("node", "vec"), "node")


def audit_recall(nodes: DataFrame, links: DataFrame, threshold: float) -> float:
    """The lower of two means of the share of links found: over nodes with links and over nodes without.

    A node counts as one, however many links it has, so that a large group does
    not hide small ones.
    """
    some = audit_sample(nodes, links).toArrow()  # at most 2 * AUDIT rows
    ids, linked = some.column("node").to_numpy(), some.column("linked").to_numpy()
    asked = unit(matrix(some.column("vec").combine_chunks())) if len(ids) else np.zeros((0, 1))

    def run(batches):
        for t in batches:
            v, q = same_width(unit(matrix(t.column("vec"))), asked)
            near = v @ q.T >= threshold
            near &= t.column("node").to_numpy()[:, None] != ids[None, :]
            due = t.column("weight").to_numpy() @ near
            yield batch(["node", "due"], ids[due > 0], due[due > 0].astype(np.int64))

    due = {r["node"]: r["due"] for r in nodes.select("node", "weight", "vec").mapInArrow(run, "node long, due long").groupBy("node").agg(F.sum("due").alias("due")).collect()}
    counts = {r["a"]: r["n"] for r in links.where(F.col("links") > 0).where(F.col("a").isin(ids.tolist())).groupBy("a").agg(F.sum("links").alias("n")).collect()}
    recall = []
    for half in (True, False):
        share = [counts.get(i, 0) / due[i] if i in due else 1.0 for i in ids[linked == half].tolist()]
        recall.append(sum(share) / len(share) if share else 1.0)
    return min(recall)


def near_duplicates(df: DataFrame, vector_col: str = "embedding", id_col: str = "vec_id", threshold: float = 0.9) -> DataFrame:
    """(id, n_links, component_id, kept) for each vector."""
    spark = df.sparkSession
    ship_package(spark)
    v = F.col(vector_col)
    rows = df.select(F.col(id_col).alias("id"), v.cast("array<double>").alias("vec"))
    usable = is_whole(F.col("vec")) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    rows = rows.select("id", F.when(usable, F.col("vec")).alias("vec")).withColumn("h1", F.when(usable, F.xxhash64("vec"))).withColumn("h2", F.when(usable, F.xxhash64(F.lit(1), "vec")))
    found = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.first("vec").alias("vec"), F.count("*").alias("weight"), F.min("id").alias("least"))
    # a node is named by its hash, so reruns agree; vectors that share the first hash get names in a row
    found = found.withColumn("node", F.col("h1") + F.row_number().over(Window.partitionBy("h1").orderBy("h2")) - 1)

    def encode(batches):
        for t in batches:
            code = codes_of(matrix(t.column("vec")))
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array([c.tobytes() for c in code], pa.binary())], names=[*t.schema.names, "code"])

    nodes = materialize(found.mapInArrow(encode, T.StructType([*found.schema.fields, T.StructField("code", T.BinaryType())])), "nodes")
    n_nodes = nodes.count()
    graph, links, recall = None, spark.createDataFrame([], LINKS), 1.0
    for k in range(TRIES if n_nodes else 0):
        more = descend(nodes, n_nodes, seed=11 + k, size=LIST << k, least=threshold - SLACK)
        if graph is not None:  # lists of both graphs, each as long as the longer of the two
            more = materialize(graph.unionByName(more).groupBy("a", "b").agg(F.max("sim").alias("sim")), "graph")
        graph = more
        links = materialize(links_of(nodes, graph, threshold), "links")
        recall = audit_recall(nodes, links, threshold)
        if recall >= RECALL:
            break
    if recall < LEAST_RECALL:
        raise RuntimeError(f"only {recall:.3f} of the links due to audited vectors were found")
    if recall < RECALL:
        warnings.warn(f"{recall:.3f} of the links due to audited vectors were found, below {RECALL}", stacklevel=2)
    degree = links.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    roots = components(links.where("b is not null").select("a", "b"))
    placed = nodes.select("node", "h1", "h2", "weight", "least").join(roots, "node", "left").join(degree, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(least, "root").select("h1", "h2", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.select("id", "h1", "h2").join(placed, ["h1", "h2"], "left")
    usable = F.col("h1").isNotNull()
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(usable, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
