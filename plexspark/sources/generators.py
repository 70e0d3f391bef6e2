"""Synthetic graphs, the same for the same seed."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from plexspark.graph import Graph


def _partner(nodes: int, seed: int, *key: Column) -> Column:
    """A vertex by hash (60 bits of an MD5, which other engines have too): unlike rand(), the same however the rows are partitioned."""
    drawn = F.conv(F.substring(F.md5(F.concat_ws("/", *key, F.lit(seed))), 1, 15), 16, 10)
    return F.pmod(drawn.cast("long"), F.lit(nodes))


def _graph(spark: SparkSession, nodes: int, first: int, each: int, seed: int) -> Graph:
    """``each`` partners for each of the first vertices; the draws are numbered through, so they are made in any number of tasks."""
    draw = F.col("id")
    ends = spark.range(first * max(each, 0)).select(F.expr(f"id div {max(each, 1)}").alias("src"), (draw % max(each, 1) + 1).alias("i"))
    return Graph.from_edges(ends.select("src", _partner(nodes, seed, F.col("src"), F.col("i")).alias("dst")), nodes)


def uniform(spark: SparkSession, nodes: int, per_node: int, seed: int = 0) -> Graph:
    """per_node // 2 random partners for every vertex, both directions."""
    return _graph(spark, nodes, nodes, per_node // 2, seed)


def skewed(spark: SparkSession, nodes: int = 10_000_000, hubs: int = 100, degree: int = 5_000_000, seed: int = 0) -> Graph:
    """The first vertices are hubs with so many random partners each, both directions."""
    return _graph(spark, nodes, min(hubs, nodes), degree, seed)
