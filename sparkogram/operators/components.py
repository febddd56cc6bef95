"""Connected components of an edge table by alternating large-star / small-star.

Every round is two grouped minima and two equi-joins, so no node's adjacency is
ever collected; the number of rounds grows with the logarithm of the longest
path.  (Kiveris et al., "Connected Components in MapReduce and Beyond", 2014.)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkogram.runtime import cut, drop_scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (a > b): connect a node's neighbours to its minimum."""
    if large:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
    else:
        arcs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    low = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = arcs.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(
            low.select(F.col("u").alias("a"), F.col("m").alias("b"))
        )
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    return (row[0], row[1] or 0)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component = smallest node.

    ``edges`` is undirected; self loops and repeats are ignored, null ends are dropped.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    e = cut(e.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "cc")
    before = _mark(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        nxt = cut(_star(_star(e, True), False), "cc")
        after = _mark(nxt)
        drop_scratch(e)
        e = nxt
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not converge")
    members = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
