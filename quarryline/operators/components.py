"""Connected components of an edge table, by alternating large-star and small-star rounds.

Every round is two aggregations and two joins; its edges are checkpointed in the shared folder, so a lost executor costs
one round. Only two numbers a round reach the driver. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def _star(directed: DataFrame, larger_only: bool) -> DataFrame:
    """From (u, v): each u's least neighbour m (u itself counts), then (v, m) for its neighbours and (u, m)."""
    least = directed.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    joined = directed.join(least, F.col("u") == F.col("_u"))
    if larger_only:
        return joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select(F.col("_u").alias("u"), F.col("m").alias("v"))).filter(F.col("u") != F.col("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges(u, v), two columns of one type with an order; component is the least node.

    Edges may repeat, run either way and join a node to itself; an empty table gives no rows. Null ends are ignored.
    """
    known = edges.toDF("u", "v").filter("u is not null and v is not null and u != v")
    now = checkpointed(known.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, larger_only=True).distinct()
        now = checkpointed(_star(large, larger_only=False).distinct())
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("node"), "component").distinct())
