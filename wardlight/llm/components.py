"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import keep


def _star(pairs: DataFrame, small: bool, rows: int) -> DataFrame:
    """Hang neighbours on the smallest node of each neighbourhood.

    ``small``: neighbours below ``u``, and ``u`` itself; else: neighbours above ``u``.
    Above ``u`` there may be very many neighbours: there the minima are written first, so that they meet their
    rows in a plain join whose large partitions Spark splits.
    """
    if small:
        low = pairs.groupBy("u").agg(F.min("v").alias("m"))
        hung = pairs.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = keep(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), rows)
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _stars(pairs: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root hangs on anything."""
    ends = pairs.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("root")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("hangs"), F.lit(1).alias("root")))
    nodes = ends.groupBy("u").agg(F.sum("hangs").alias("hangs"), F.max("root").alias("root"))
    return nodes.where("hangs > 1 or hangs = 1 and root = 1").limit(1).count() == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node on an edge; the component is its smallest node.

    Loops, repeated edges and edges with a null end add nothing. Every round is written to the shared
    folder; the number of rounds grows with the logarithm of the longest path. Only row counts
    reach the driver.
    """
    u, v = F.col(a).cast("long"), F.col(b).cast("long")
    pairs = keep(edges.where(u.isNotNull() & v.isNotNull() & (u != v)).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    rows = pairs.count()
    while not _stars(pairs):
        # a round never adds pairs: one comes from each pair above a node, then one for each pair and node
        pairs = keep(_star(_star(pairs, False, 2 * rows), True, 2 * rows), 2 * rows)
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.distinct())
