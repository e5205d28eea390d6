"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from panelmill.llm.stores import Stores


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges`` (a > b) has one smaller neighbour, which has none itself, or only larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.where("up > 1 or (up = 1 and down = 1)").count() == 0


def components(edges: DataFrame, stores: Stores) -> DataFrame:
    """(node, component): every node of ``edges`` (a, b: long) with the smallest node it reaches.

    Each round points the neighbours of a node at the smallest of them, until
    all edges form stars. The number of rounds grows with the logarithm of the
    longest path, edges that are stars take none, and the edge table never
    grows. Every round is stored, so lineage stays short and a lost
    executor repeats one round. Smallest neighbours are found by partial
    aggregation; the join back has one row per node on one side, so a hub with
    many edges can be split.
    """
    current = stores.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _are_stars(current):
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # One row per edge: repeats go with those of the second step.
        large = both.where("b > a").join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.where("a <> b").unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        current = stores.keep(small)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stores.keep(roots.unionByName(current.select(F.col("a").alias("node"), F.col("b").alias("component"))))
