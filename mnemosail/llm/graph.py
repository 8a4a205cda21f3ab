"""Connected components with DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each end of ``edges`` (a, b), both long.

    Each round hooks every node to its smallest smaller neighbour, flattens the
    resulting trees by pointer jumping, and replaces the ends of the edges by
    the roots. Minima are combined before the shuffle, and all joins are inner or left equi-joins that may
    be split, so a hub with many links is no single task's work. Every round at least halves
    the nodes that still have edges between roots, but for local minima, whose
    neighbours all leave in that round.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, "edges", 8, F.count("*"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    roots = nodes.withColumn("root", F.col("node"))
    while edges.table_seen:
        parent = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up")), "parents", 8)
        while True:
            # two jumps in one step: a parent's parent, and that one's
            above = parent.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            top = parent.select(F.col("node").alias("upper"), F.col("up").alias("top"))
            step = parent.join(above, "up", "left").join(top, "upper", "left")
            step = step.select("node", F.coalesce("top", "upper", "up").alias("up"), F.col("top").isNotNull().alias("moved"))
            step = materialize(step, "parents", 8, F.count_if("moved"))
            parent = step.select("node", "up")
            if not step.table_seen:
                break
        up = parent.select(F.col("node").alias("root"), "up")
        roots = materialize(roots.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots", 8)
        pa, pb = (parent.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}")) for c in "ab")
        ends = edges.join(pa, "a", "left").join(pb, "b", "left").select(F.coalesce("up_a", "a").alias("a"), F.coalesce("up_b", "b").alias("b"))
        edges = materialize(ends.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges", 8, F.count("*"))
    return roots
