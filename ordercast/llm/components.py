"""Connected components by alternating stars, as joins and groupings of the edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ordercast.llm.common import stage


def _large_star(edges: DataFrame) -> DataFrame:
    """Each vertex' larger neighbours get linked to the smallest vertex around it."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours get linked to the smallest of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    moved = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b): the smallest vertex reachable.

    Each round is a few groupings over at most as many edges as before, written to the shared folder,
    until nothing changes; the number of rounds grows with the logarithm of the longest chain. Edges
    from a vertex to itself are allowed; null ends are ignored.
    """
    tilted = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now = stage(tilted.distinct(), "edges")
    mark = None
    while True:
        # A star is settled when both steps leave every edge as it is.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
        now = stage(_small_star(_large_star(now)), "edges")
    roots = now.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionAll(roots)
