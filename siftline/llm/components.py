"""Connected components by alternating large and small stars; all links stay in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftline.llm.common import drop_stash, join_salted, stash


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one root, and no root on anything: all components are stars."""
    n, nodes = edges.agg(F.count("*"), F.countDistinct("a")).first()
    return n == nodes and edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node of edges (a, b: long) that is not the smallest of its component, which is its root.

    Each round hangs the larger neighbours of a node on the smallest of them, then all on that; the number of rounds grows with
    the logarithm of the component's size. The neighbours of a hub are dealt over salts. Loops and repeated or reversed links do no harm, no links give no rows.
    """
    now = stash(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = join_salted(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stash(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop_stash(now)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
