"""Connected components of an edge table by alternating large-star and small-star steps; nothing goes to the driver but counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    tied = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(sid, label): each node of edges (a, b), with the least node that it reaches. Self-loops and repeats do no harm.

    Steps go on until nothing changes, after some log2(nodes)^2 of them at most.
    """
    edges = stage_table(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before, after = None, _state(edges)
    while after != before:
        edges = stage_table(_small_star(_large_star(edges)), "edges")
        before, after = after, _state(edges)
    roots = edges.select(F.col("b").alias("sid")).distinct()
    return edges.select(F.col("a").alias("sid"), F.col("b").alias("label")).unionByName(roots.select("sid", F.col("sid").alias("label")))


def contract(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after more links (a, b), which may name nodes that have no label yet."""
    return components(labels.select(F.col("sid").alias("a"), F.col("label").alias("b")).unionByName(links.select("a", "b")))
