"""Breadth-first search from one source or several, a level a round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexspark.operators.edge_map import Dealt
from plexspark.operators.iterate import iterate


def search(g, sources: DataFrame, edges: Dealt | None = None) -> DataFrame:
    """(source, id, depth, parent) of all vertices that each of ``sources`` (source) reaches; a parent is the least of those possible."""
    if edges is None:
        with g.dealt("src", "dst") as edges:
            return search(g, sources, edges)
    own = sources.select(F.col("source").cast("long")).where("source IS NOT NULL").distinct()
    first = own.select("source", F.col("source").alias("id"), F.struct(F.lit(0).alias("depth"), F.col("source").alias("parent")).alias("value"))
    step = F.struct((F.col("value.depth") + 1).alias("depth"), F.col("src").alias("parent"))
    return iterate(edges, first, step, F.min, keys=["source"]).select("source", "id", "value.*")


def one(g, source: int) -> DataFrame:
    g.require(source)
    return search(g, g.spark.range(1).select(F.lit(source).cast("long").alias("source"))).drop("source")


def depths(g, source: int) -> DataFrame:
    """(id, depth): -1 where the source does not lead."""
    return g.vertices.join(one(g, source), "id", "left").select("id", F.coalesce("depth", F.lit(-1)).alias("depth"))


def parents(g, source: int) -> DataFrame:
    """(id, parent): the source is its own; -1 where it does not lead."""
    return g.vertices.join(one(g, source), "id", "left").select("id", F.coalesce("parent", F.lit(-1)).cast("long").alias("parent"))
