"""Connected components of a link table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.sources.storage import written


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (smallest node reachable) for each node of ``links`` (a, b: long) but the roots.

    Alternates two steps until nothing changes: every node hands its larger neighbours to its
    smallest one, then its smaller neighbours and itself. The number of rounds grows with the
    logarithm of the longest path. A step is one minimum per node, combined before the shuffle, and
    a join with it, so a node with very many links is dealt to several tasks like any skewed join.
    """
    edges = written(directed(links), "links")
    seen = None
    while (state := fingerprint(edges)) != seen:
        seen = state
        edges = written(small_star(written(large_star(edges), "links")), "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def directed(links: DataFrame) -> DataFrame:
    """Each link once, from the larger to the smaller node."""
    return links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    return directed(both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b")))


def small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("least"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return directed(moved.unionByName(least.select("a", F.col("least").alias("b"))))


def fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
