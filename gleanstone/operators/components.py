"""Connected components of an edge list by alternating star contraction, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanstone.session import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable; ``edges`` has columns a and b, any direction, loops allowed.

    Each round hooks every node's larger neighbours to its smallest one, then every node's smaller
    neighbours; both are grouped minima and joins, so a hub spreads over the shuffle like any rows.
    Rounds are checkpointed and go on until the edges no longer change.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    before = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(small)
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("d")).first()
        if before == (state["n"], state["d"]):
            break
        before = (state["n"], state["d"])
    roots = now.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(roots, nodes["node"] == roots["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
