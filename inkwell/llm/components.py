"""Connected components of a distributed graph by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node reachable) of every node that has a link; links: columns a, b (long).

    Each round makes every node point to smaller neighbours only (Kiveris et al., 2014), in a
    logarithmic number of rounds. A node's smallest neighbour is a partial aggregate and is joined
    back, so a node with many links is never gathered in one place; rounds are written to the shared
    folder. Nothing but one count and one checksum a round comes to the driver.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = scratch.keep(edges, "edges")
    before = None
    while True:
        # Large star: larger neighbours of u move to the smallest of u and its neighbours.
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours move to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.keep(small, "edges")
        state = after.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        scratch.drop(edges)
        edges = after
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = state
