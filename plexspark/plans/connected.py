"""Components: by stars for links without direction, by least labels along directed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexspark.operators.iterate import iterate
from plexspark.plans.lineage import cut, scratch


def _settled(links: DataFrame) -> bool:
    """Whether the links (lo, hi) are stars: no upper end has two lower ones, or is one itself. Ends are counted before they are exchanged."""
    ends = links.select(F.explode(F.array(F.struct(F.col("lo").alias("node"), F.lit(0).alias("upper")), F.struct(F.col("hi").alias("node"), F.lit(1).alias("upper")))).alias("e")).select("e.*")
    ends = ends.groupBy("node").agg(F.sum("upper").alias("upper"), F.count("*").alias("all"))
    return ends.where("upper > 1 OR (upper = 1 AND all > 1)").isEmpty()


def _stars(links: DataFrame, x: Column, y: Column) -> DataFrame:
    """(lo, hi), a table: every node that has a link to another under the smallest one reachable."""
    links = cut(links.where(x != y).select(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi")).distinct())
    while not _settled(links):
        both = links.select(F.col("lo").alias("u"), F.col("lo").alias("v")).union(links.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")))
        links = cut(links.join(least, F.col("lo") == F.col("u")).select(F.col("m").alias("lo"), "hi").distinct())
        least = cut(links.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        small = links.join(least, F.col("hi") == F.col("u")).select(F.col("m").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b")
        links = cut(small.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    return links


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link to another; component is the smallest node reachable.

    Each round hangs the larger ends of every node's links under its smallest
    neighbour (large star), then does the same with its smaller ends (small
    star), until all links are stars. The rounds needed grow with the logarithm of the number of nodes,
    also for long chains. Minima are aggregated before they are exchanged, and
    joining them back is a join whose hot keys Spark can split, as both sides
    are read from tables; no node's links meet in one task or in the driver.

    Links with a null end and links of a node to itself count for nothing;
    repeated links count once; without links the result is empty.
    """
    with scratch() as keep:
        links = keep(_stars(links, F.col(a), F.col(b)))
    inside = links.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return inside.union(links.select("lo", "lo").distinct())


def labels(g, weak: bool = False) -> DataFrame:
    """(id, component): the least id of the component.

    On a directed graph, labels follow the edges: the least id among a vertex
    and those that lead to it; ``weak`` takes edges as links instead.
    """
    if g.directed and not weak:
        return _downstream(g)
    found = components(g.edges, "src", "dst").withColumnRenamed("node", "id")
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _downstream(g) -> DataFrame:
    """Least ids along the edges; a label leads to its vertex, so labels of labels count too (pointer jumping)."""
    own = g.vertices.select("id", F.col("id").alias("value"))
    with g.dealt("src", "dst") as edges:
        found = iterate(edges, own, F.col("value"), F.min, update=lambda old, new: F.when(new < old, new), jump=True)
    return found.withColumnRenamed("value", "component")
