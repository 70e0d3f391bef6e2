"""Vertex sets: frames with a column id. Spark needs no sparse and dense forms of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def single(spark: SparkSession, vertex: int) -> DataFrame:
    return spark.range(1).select(F.lit(vertex).cast("long").alias("id"))


def of(spark: SparkSession, vertices: list[int]) -> DataFrame:
    return spark.createDataFrame([(v,) for v in vertices], "id long")


def members(frontier: DataFrame, vertices: DataFrame) -> DataFrame:
    """Those of ``vertices`` that are in the frontier."""
    return vertices.join(frontier.select("id"), "id", "left_semi")


def insert(frontier: DataFrame, more: DataFrame) -> DataFrame:
    return frontier.select("id").union(more.select("id")).distinct()


def size(frontier: DataFrame) -> int:
    return frontier.count()


def non_empty(frontier: DataFrame) -> bool:
    return not frontier.isEmpty()


def out_degree(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that leave the set, one row (total): each edge is counted where it is, none is gathered."""
    inside = edges.join(frontier.select(F.col("id").alias("src")).distinct(), "src", "left_semi")
    return inside.agg(F.count("*").alias("total"))
