"""Connected components by alternating stars, and nothing of the graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from redpen.llm.common import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(u, v) edges of any one orderable type to (node, comp): comp is the smallest node reached. Nodes without edges don't occur.

    A star's centre can have any number of neighbours: its minimum is pre-aggregated, and handing it out is a
    join whose skewed keys Spark may split. An empty table of edges gives no rows.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    edges = scratch.table(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    last = _fingerprint(edges)
    while last[0]:
        # large star: every larger neighbour goes to the smallest of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        # small star: u and its smaller neighbours go to the smallest of those; an edge is (u smaller, v larger)
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").where("u > m").select(F.col("m").alias("u"), F.col("u").alias("v")).union(least.select(F.col("m").alias("u"), "v"))
        edges = scratch.table(small.where("u <> v").distinct(), "edges")
        now = _fingerprint(edges)
        if now == last:
            break
        last = now
    pairs = edges.select(F.col("v").alias("node"), F.col("u").alias("comp")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("comp")).distinct())
    return scratch.table(pairs, "components")
