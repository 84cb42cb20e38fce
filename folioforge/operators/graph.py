"""Connected components over link tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of ``edges``; component is the least node of its component.

    Alternating large-star and small-star steps: each node's neighbours are linked to the least of
    them, so paths shrink by a constant factor a round and no node ever gathers its component. Every
    round is one written table (lineage is cut), and only two numbers reach the driver.
    Null ends are left out; a self-link gives a component of one node.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = e.select("u").union(e.select(F.col("v").alias("u"))).distinct()
    e = materialize(e.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:  # until a round changes nothing
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large-star: neighbours above the node are linked to the least one around it
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small-star: the lower neighbours of a node are linked to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("u", "v", "m")
        e = materialize(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    return nodes.join(e.groupBy("u").agg(F.min("v").alias("v")), "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))
