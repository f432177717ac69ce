"""Connected components of an edge table by alternating large-star and small-star steps.

Only joins and minimum aggregates: no node's neighbours are gathered in one task, so a hub's edges are
split by the skew handling of sort-merge joins and its minimum is pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, materialize


def _state(edges: DataFrame) -> tuple:
    """Count and two XORs of 64-bit hashes: equal for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v); root is the smallest node of its component."""
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    edges = materialize(edges, "edges")
    state = None
    while (now := _state(edges)) != state:
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        old, edges = edges, materialize(small, "edges")
        drop(edges.sparkSession, [old.folder])
    root = edges.groupBy("u").agg(F.min("v").alias("root"))
    return root.select(F.col("u").alias("node"), "root").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct().join(root.select(F.col("u").alias("node")), "node", "left_anti"))
