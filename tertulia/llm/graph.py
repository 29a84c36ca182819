"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tertulia.llm.common import checkpointed


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over ``edges`` (u, v): neighbours move to the smallest node next to u."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both if large else both.where("v < u")
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.where("v > u") if large else near
    out = moved.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; the root is the component's smallest node.

    ``edges`` has columns u and v of one type.  Each round moves nodes closer to their root and is written
    to the shared folder; rounds grow with the logarithm of the longest chain.
    """
    now = checkpointed(edges.select("u", "v").where("u <> v").distinct())
    seen = None
    while True:
        sign = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.pmod(F.xxhash64("v", "u"), F.lit(1 << 40)))).first()
        if sign == seen or sign[0] == 0:
            break
        seen = sign
        now = checkpointed(_star(checkpointed(_star(now, True)), False))
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
