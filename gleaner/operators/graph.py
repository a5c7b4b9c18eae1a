"""Reachable sets of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the distinct links (a, b), a < b: root is the least node reachable.

    Large-star and small-star steps in turn hang a node's neighbours on the least of them, until only stars are left; links
    that are stars already take no step. Every step is written to the shared folder; nothing is collected.
    """

    def hang(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
            least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
            out = e.join(least, "a").select(F.col("m").alias("a"), "b")  # of a node's neighbours only the larger ones move
        else:
            least = e.groupBy("b").agg(F.min("a").alias("m"))
            out = e.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        return out.filter("a < b").distinct()

    def stars(e: DataFrame) -> bool:
        ends = e.select("a", F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("a"), F.lit(0).alias("up")))
        return ends.groupBy("a").agg(F.max("up").alias("up"), F.sum(1 - F.col("up")).alias("down")).filter("down + up > 1 and down > 0").isEmpty()

    edges = materialize(edges, "links")
    while not stars(edges):
        edges = materialize(hang(materialize(hang(edges, True), "stars"), False), "stars")
    roots = edges.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("root")))
