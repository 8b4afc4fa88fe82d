"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _least(edges: DataFrame) -> DataFrame:
    """(u, least): the smallest of each node and its neighbours; partial minima are formed before the shuffle."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("least"))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (columns a, b, any comparable type); component is its smallest node.

    Each round shuffles by node with map-side minima and writes its edges to the shared folder. A hub is
    a skewed key of a join that adaptive execution splits. Edges with a null end are left out.
    """
    current = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and a != b").distinct(), "edges")
    seen = None
    for _ in range(max_rounds):
        state = current.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if not state[0] or tuple(state) == seen:
            break
        seen = tuple(state)
        # large star: every larger neighbour of u goes to the smallest node around u
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), F.col("u") == F.col("_u")).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()
        # small star: every smaller neighbour of u, and u, go to the smallest of them
        small = large.join(_least(large), F.col("u") == F.col("_u"))
        moved = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("least").alias("v")), F.struct("u", F.col("least").alias("v")))).alias("e"))
        current = staged(moved.select("e.u", "e.v").where("u != v").distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
