"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import stage

EDGES_PER_TASK = 200_000


def _state(edges: DataFrame) -> tuple:
    """Number of edges and an order-free hash of them."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every end of an edge; the component is its smallest node.

    ``edges`` has long columns u and v.  Each round links the neighbours of a
    node to the smallest among them; minima are taken map-side first, and the
    rows of a node with very many neighbours are joined, never gathered.
    Rounds grow with the logarithm of the longest path.
    """
    e = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(e)
    while state[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # As many tasks as the edges need: the rounds on a small graph are short ones.
        parts = -(-state[0] // EDGES_PER_TASK)
        least = stage(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).coalesce(parts))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct().coalesce(parts))
        least = stage(large.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts))
        moved = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct().coalesce(parts))
        now = _state(e)
        if now == state:
            break
        state = now
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
