"""Connected components of a graph of links that stays distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.shared import drop_table, materialize


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is hung on the least neighbour of that node."""
    sym = _both_ways(edges)
    least = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return sym.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (u, v), component being the least node reachable.

    Alternates large-star and small-star until the edges no longer change. Each round reads and writes a
    table of at most as many rows as there are links, with partial minima before each shuffle; the driver sees
    only a count and a checksum. Links of a node to itself and repeated links do no harm; no links give no rows.
    """
    edges = materialize(edges.select("u", "v").where("u <> v").distinct(), "links")
    before = None
    for _ in range(rounds):
        step = _small_star(_large_star(edges).where("u <> v").distinct()).where("u <> v").distinct()
        new = materialize(step, "links")
        drop_table(edges)
        edges = new
        n, total = edges.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
        ).first()
        if (n, total) == before:
            break
        before = (n, total)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
