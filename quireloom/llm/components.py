"""Connected components by alternating large and small stars (Kiveris et al., 2014).

Minima come from partial aggregates and meet their rows again in joins that
adaptive execution splits, so a node with very many neighbours is no single
task's burden.  Before the first round each task contracts its bounded share of the
links to stars, which leaves few of them.  Each round is written to shared storage; nothing is collected
but a count and a checksum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quireloom.session import materialize, ship_package

#: Links that one task contracts before the rounds begin.
PART_LINKS = 500_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = _both_ways(edges)
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def forest(a: np.ndarray, b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among 0..n-1: each node with its component's least."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            break
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def _contract(edges: DataFrame, parts: int) -> DataFrame:
    """The links of each partition as stars around the least node they connect there."""
    ship_package(edges.sparkSession)

    def run(batches):
        held = list(batches)
        if held:
            a, b = (np.concatenate([t.column(c).to_numpy() for t in held]) for c in ("a", "b"))
            ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
            i, j = forest(place[: len(a)], place[len(a) :], len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[j])], names=["a", "b"])

    return edges.repartition(parts).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, root): each linked node's least reachable node.

    Nodes without a link, and roots themselves, have no row.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "links")
    parts = max(1, -(-edges.count() // PART_LINKS))
    edges = materialize(_contract(edges, parts), "stars")
    before = None
    while parts > 1:  # links of one partition are done; those of several meet in rounds
        edges = materialize(_small_star(_large_star(edges)), "stars")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == before or now[0] == 0:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
