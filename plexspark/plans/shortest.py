"""Bellman-Ford shortest paths from one source, in rounds over what became shorter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexspark.operators.iterate import State, iterate
from plexspark.plans.lineage import cut

#: Distance of what is not reached; its negative stands everywhere if a negative cycle is.
UNREACHED = 1073741823


def _circular(state: DataFrame, n: int, source: int) -> bool:
    """Whether parents of n vertices lead round in a circle: doubling the steps, all must come to the source."""
    step, far = state.select("id", "parent"), 1
    while far < n:
        over = step.select(F.col("id").alias("parent"), F.col("parent").alias("next"))
        step, far = cut(step.join(over, "parent").select("id", F.col("next").alias("parent"))), 2 * far
    return not step.where(F.col("parent") != source).isEmpty()


def _relaxed(g, source: int) -> DataFrame | None:
    """(id, dist, parent) of all vertices that are reached, or None if a negative cycle is."""
    at, weight = F.lit(source).cast("long"), F.col("weight") if g.weighted else F.lit(1)
    with g.dealt("src", "dst", *(["weight"] if g.weighted else [])) as edges:
        below = edges.edges.where(weight < 0)

        def cycle(n: int, sent: DataFrame, state: State) -> bool:
            if not g.directed and not below.join(sent.select(F.col("id").alias("src")), "src", "left_semi").isEmpty():
                return True
            if n < 4 or n & (n - 1):
                return False
            reached = state.whole()
            size = reached.count()
            return n > size or _circular(reached.select("id", "value.*"), size, source)

        first = g.spark.range(1).select(at.alias("id"), F.struct(F.lit(0).cast("long").alias("dist"), at.alias("parent")).alias("value"))
        step = F.struct((F.col("value.dist") + weight).alias("dist"), F.col("src").alias("parent"))
        shorter = lambda old, new: F.when(old.isNull() | (new["dist"] < old["dist"]), new)
        out = iterate(edges, first, step, F.min, update=shorter, check=None if below.isEmpty() else cycle)
        return None if out is None else out.select("id", "value.*")


def distances(g, source: int) -> DataFrame:
    """(id, dist) as int; edges without weights count 1.

    A round relaxes the edges of the vertices that became shorter in the last.
    A negative cycle shows as a circle among parents, which is looked for after
    4, 8, 16, ... rounds if there are weights below 0, and at the latest in that
    paths become shorter after more rounds than vertices are reached; every
    distance then is -UNREACHED. An undirected graph that reaches an edge below
    0 has such a cycle in that edge itself.
    """
    g.require(source)
    state = _relaxed(g, source)
    if state is None:
        return g.vertices.select("id", F.lit(-UNREACHED).alias("dist"))
    return g.vertices.join(state, "id", "left").select("id", F.coalesce("dist", F.lit(UNREACHED)).cast("int").alias("dist"))
