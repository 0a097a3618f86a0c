"""Connected components of a links table, by rounds of star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, component): every node of `links` (a, b: long) with the smallest node it reaches, itself included.

    Large-star and small-star rounds: each node's neighbours move to its smallest neighbour until every link points at
    a component's smallest node. Only minima are gathered per node, never a list of neighbours, so a hot node costs a
    partial aggregate and a join. Each round is a written table; links with a null end or equal ends take no part.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    edges, before = staged(edges, "links"), None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)), F.coalesce(F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 20))), F.lit(0))).first()
        if before == now:
            break
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct(), "links")
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
