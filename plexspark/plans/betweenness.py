"""Dependencies of all vertices on one source or several (the inner part of Brandes' betweenness).

Forward, the number of shortest paths is summed level by level; backward, a
vertex takes over (1 + dependency) of each child in the share of its paths. The
source keeps its value, the number of vertices reached beside itself; vertices
that are not reached have NaN. Several sources go through the same rounds.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexspark.operators.edge_map import edge_map
from plexspark.plans.lineage import cut, cut_counted, scratch

BY = ["source", "id"]


def of_sources(g, sources: DataFrame, transpose_backward: bool = False) -> DataFrame:
    """(source, id, dependency) of what each of ``sources`` (source) reaches."""
    if g.directed and not transpose_backward:
        raise NotImplementedError("on directed graphs the dependency needs transpose_backward=True")
    own = sources.select(F.col("source").cast("long")).where("source IS NOT NULL").distinct()
    with scratch() as keep, g.dealt("src", "dst", both=g.directed) as edges:
        levels = [cut(own.select("source", F.col("source").alias("id"), F.lit(1.0).alias("paths")))]
        seen = levels[0].select(BY)
        while True:
            new, found = cut_counted(edge_map(edges, levels[-1], F.col("paths"), F.sum, cond=seen, keys=["source"]).withColumnRenamed("value", "paths"))
            if not found:
                break
            levels.append(new)
            if g.directed:
                seen = seen.union(new.select(BY))
            else:  # neighbours are at most one level apart
                seen = levels[-2].select(BY).union(new.select(BY))
        out = [keep(cut(levels[-1].select(*BY, "paths", F.lit(0.0).alias("dependency"))))]
        for level in reversed(levels[:-1]):
            # An undirected graph has each edge in both directions, so nothing need go against them.
            share = edge_map(edges, out[-1], (1 + F.col("dependency")) / F.col("paths"), F.sum, inward=g.directed, keys=["source"])
            below = level.join(share, BY, "left")
            out.append(keep(cut(below.select(*BY, "paths", (F.col("paths") * F.coalesce("value", F.lit(0.0))).alias("dependency")))))
    return functools.reduce(DataFrame.union, out).select(*BY, "dependency")


def dependencies(g, source: int, transpose_backward: bool = False) -> DataFrame:
    """(id, dependency). A directed graph needs ``transpose_backward``: children are followed back along their edges."""
    g.require(source)
    found = of_sources(g, g.spark.range(1).select(F.lit(source).cast("long").alias("source")), transpose_backward).drop("source")
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("dependency", F.lit(float("nan"))).alias("dependency"))
