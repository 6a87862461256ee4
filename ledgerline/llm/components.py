"""Connected components of a graph held as a table of edges, by large-star and small-star rounds.

Each round gives every node the smallest node it sees, on edges alone: no list of neighbours is
ever held in one row. The smallest nodes are written before they meet the edges, so that the join is
one of two plain exchanges, in which Spark splits a node with very many edges. The edges stay in tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stored(down.groupBy("a").agg(F.min("b").alias("m")))
    other = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return other.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each node that has an edge to another, but the smallest of its component, with that one.

    edges: a and b, long; loops and repeated edges do no harm.
    """
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003), F.sum(F.hash("b", "a").cast("long"))).first())
    edges = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = mark(edges)
    while seen[0]:
        edges = stored(_small_star(_large_star(edges)))
        now = mark(edges)
        if now == seen:
            break
        seen = now
    return edges
