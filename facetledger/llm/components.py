"""Connected components of a graph given as a table of edges, and the smallest node of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetledger.runtime import stage


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links the neighbours of each node (the larger ones, or the smaller ones and the node itself) to its least neighbour."""
    if larger:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        linked = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """For each node with an edge (columns u, v) its component: node, component (the smallest node).

    Alternating star contractions: a logarithmic number of rounds, each with sums per node and joins on the node, so that
    a node with very many edges is an ordinary skewed join. Each round is cut by a table in the shared folder; only its
    size and a checksum come to the driver.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    current, before = stage(ordered), None
    while True:
        now = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20)"))).first()
        if now == before:
            break
        before, current = now, stage(_star(_star(current, True), False))
    roots = current.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
