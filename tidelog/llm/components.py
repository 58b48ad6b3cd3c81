"""Connected components by alternating large-star and small-star steps, each written to the
shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of an edge can reach. Large-star
    links what is above a node to the least that the node knows, small-star what is
    below; they alternate until the links stay as they are."""

    def least(of: DataFrame) -> DataFrame:
        return of.groupBy("node").agg(F.least(F.min("other"), "node").alias("least"))

    def state(of: DataFrame) -> tuple:
        return tuple(of.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20)"))).first())

    edges = staged(edges.distinct(), "links")
    now = state(edges)
    while now[0]:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        above = both.join(least(both), "node").where(F.col("other") > F.col("node"))
        large = staged(above.select(F.col("least").alias("a"), F.col("other").alias("b")).distinct(), "large")
        below = large.select(F.col("b").alias("node"), F.col("a").alias("other"))
        to = below.join(least(below), "node")
        small = to.where(F.col("other") != F.col("least")).select(F.col("least").alias("a"), F.col("other").alias("b")).union(to.select(F.col("least").alias("a"), F.col("node").alias("b")))
        edges = staged(small.distinct(), "small")
        if (then := state(edges)) == now:
            break
        now = then
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
