"""Connected components by alternating large-star and small-star steps, all on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm import common


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable over links (a, b); nodes without a link are left out.

    Loops and repeated links are harmless; no links give no rows. Every round is written to the shared folder,
    so lineage stays short, and the round before is deleted; the driver sees a count and a checksum of each round. Nodes
    with a large share of the links have them dealt over all tasks.
    """
    edges = common.settle(
        links.where("a <> b and a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _mark(edges)
    spread = -1 - F.col("v")  # deals the rows of a hub by their other ends; where that is a node's number, it finds none of its own
    while before[0]:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = common.join_groups(both.where("v > u"), least, "u", 2 * before[0], spread).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.join_groups(large, lowest, "u", 2 * before[0], spread).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        old, edges = edges, common.settle(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        common.discard(old)
        after = _mark(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
