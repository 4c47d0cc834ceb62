"""Connected components by alternating large and small stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import cut, free


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node hands the least of itself and its neighbours to its larger (large) or smaller neighbours.

    The least ones are cut off from their plan, so that the join has two plain shuffles and a node with very many
    edges can be split.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:  # from the larger end to the smaller
        both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    told = both.join(least, "u")
    if large:
        out = told.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = told.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = cut(out.where("a <> b").distinct())
    free(least, edges)
    return out


def connected_components(edges: DataFrame) -> DataFrame:
    """node and component (the least node of it) of every node that has an edge. edges: a and b, longs, in any order.

    Goes on until nothing changes, which a logarithmic number of rounds reaches for any graph. Loops and repeated edges
    are let pass; an empty table gives an empty one.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")), F.expr("bit_xor(xxhash64(a, b))")).first()
        if state == before or not state[0]:
            break
        before = state
        now = _star(_star(now, large=True), large=False)
    nodes = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
