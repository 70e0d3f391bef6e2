"""k-cores: what is left when vertices of fewer than k neighbours are taken away, again and again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexspark.operators.iterate import iterate
from plexspark.plans.totals import degrees


def core(g, k: int) -> DataFrame:
    """(id, degree) of the vertices of the k-core, with their neighbours inside it; loops don't count.

    A vertex that falls below k tells its neighbours once; edges of a directed
    graph are taken as links.
    """
    links = g.edges.select("src", "dst").where("src <> dst")
    if g.directed:
        links = links.union(links.select("dst", "src")).distinct()
    state = degrees(type(g)(g.vertices, links)).select("id", F.col("degree").alias("value"))
    falls = lambda old, new: (old >= k) & (new < k)
    out = iterate(links, state, F.lit(1).cast("long"), F.sum, update=lambda old, new: old - new, sends=falls, first=state.where(F.col("value") < k))
    return out.where(F.col("value") >= k).withColumnRenamed("value", "degree")
