"""Connected components of a graph of long ids, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtide.session import settled


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's larger (large star) or smaller (small star) neighbours with its smallest."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    found = both.join(least, "a")
    if large:
        found = found.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        found = found.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return found.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links, either way round, to (a, b): every linked node but the smallest, and the smallest it reaches.

    No node's links are collected; each round is checkpointed in the shared
    folder. No links give no rows; loops and repeated links change nothing.
    """
    edges = settled(edges.where("a != b").distinct())
    seen = None
    while True:
        edges = settled(_star(_star(edges, large=True), large=False))
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == seen:
            return edges
        seen = state
