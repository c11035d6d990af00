"""Connected components by alternating large and small stars, on tables alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _linked_to_least(links: DataFrame) -> DataFrame:
    """links (u, v) with m, the least node among u and its neighbours."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").withColumn("m", F.least("u", "m"))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (u long, v long) that isn't its component's least, which is the root.

    Each round hangs every node's larger neighbours, then its smaller ones, on its least neighbour, which halves the depth;
    it ends when the links no longer change. Neighbours are never gathered: a node with very many is a skewed join's key.
    """
    now = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    state = None
    while True:
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
        if seen == state or not seen["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = seen
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _linked_to_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = large.where("u <> v").distinct()
        small = _linked_to_least(down).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = written(small.where("u <> v").distinct(), "links")
