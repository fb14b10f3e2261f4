"""Connected components by contraction: each node moves to the root of its smallest neighbours until no link is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _roots(step: DataFrame) -> DataFrame:
    """step(node, to) with to <= node, every `to` a node too -> the same with `to` the end of each chain, in log2 of its length rounds."""
    step = stored(step)
    while True:
        ahead = step.select(F.col("node").alias("to"), F.col("to").alias("ahead"))
        jumped = stored(step.join(ahead, "to").select("node", F.col("ahead").alias("to"), (F.col("ahead") != F.col("to")).alias("moved")))
        step = jumped.select("node", "to")
        if jumped.filter("moved").isEmpty():
            return step


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """links(a, b) -> (node, component): the smallest node reachable, for every node that has a link.

    Loops and repeated links are ignored; an empty table gives no rows. Each round points every
    node to its smallest neighbour, follows these pointers to their ends, replaces the ends of every
    link by them and drops what became a loop, so links shrink geometrically, whatever their shape;
    nothing is collected. A hub with many links is split by AQE's skew join.
    """
    a, b = F.col("a"), F.col("b")
    links = stored(links.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    names = None
    for _ in range(max_rounds):
        both = links.union(links.select("b", "a"))
        step = _roots(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("to")))
        if names is None:
            names = step.select("node", F.col("to").alias("component"))
        else:
            names = stored(names.join(step.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component")))
        left = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        links = stored(left.filter("ta != tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct())
        if links.isEmpty():
            return names
    raise RuntimeError(f"components: links are left after {max_rounds} rounds")
