"""Graph encoder embedding: how much of each class a vertex's neighbours make up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexspark.plans.lineage import cut_observed
from plexspark.plans.totals import touching


def _classes(labels: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Known labels (id, cluster), and (cluster, its size)."""
    if k <= 0:
        raise ValueError("the number of classes must be positive")
    known = labels.where("label >= 0").select(F.col("id").cast("long"), F.col("label").cast("int").alias("cluster"))
    if not known.where(F.col("cluster") >= k).isEmpty():
        raise ValueError(f"labels must be below {k}")
    return known, known.groupBy("cluster").agg(F.count("*").alias("size"))


def _grid(g, k: int, sums: DataFrame) -> DataFrame:
    """All vertices by all classes, 0 where nothing was summed; k rows a vertex by an explode, no cross join."""
    cells = g.vertices.select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cluster"))
    return cells.join(sums, ["id", "cluster"], "left").select("id", "cluster", F.coalesce("value", F.lit(0.0)).alias("value"))


def _summed(rows: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """(id, cluster, value) of rows (id, other, w): weights by the class of the other end, over the class's size."""
    known, sizes = _classes(labels, k)
    seen = rows.join(known.withColumnRenamed("id", "other"), "other").groupBy("id", "cluster").agg(F.sum("w").alias("w"))
    return seen.join(sizes, "cluster").select("id", "cluster", (F.col("w") / F.col("size")).alias("value"))


def unweighted(g, labels: DataFrame, k: int) -> DataFrame:
    """(id, cluster, value): twice the neighbours of a class over its size; on directed graphs in- and out-neighbours, a loop once."""
    into = g.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))
    if g.directed:
        rows = into.withColumn("w", F.lit(1.0)).union(g.edges.where("src <> dst").select("src", "dst", F.lit(1.0)))
    else:
        rows = into.withColumn("w", F.lit(2.0))
    return _grid(g, k, _summed(rows, labels, k))


def weighted(g, labels: DataFrame, k: int, laplacian: bool = False) -> DataFrame:
    """(id, cluster, value) with weights in place of counts, from both ends of every entry, a loop once.

    ``laplacian`` divides a weight by the square root of the product of the
    weighted degrees of its ends, which must be positive.
    """
    edges = g.edges.select("src", "dst", F.col("weight").cast("double").alias("w")) if g.weighted else g.edges.select("src", "dst", F.lit(1.0).alias("w"))
    if laplacian:
        degree, seen = cut_observed(touching(g), least=F.min("degree"))
        if seen["least"] is not None and seen["least"] <= 0:
            raise ValueError("the Laplacian needs positive weighted degrees")
        ends = edges.join(degree.select(F.col("id").alias("src"), F.col("degree").alias("a")), "src").join(degree.select(F.col("id").alias("dst"), F.col("degree").alias("b")), "dst")
        edges = ends.select("src", "dst", (F.col("w") / F.sqrt(F.col("a").cast("double") * F.col("b"))).alias("w"))
    rows = edges.select(F.col("dst").alias("id"), F.col("src").alias("other"), "w").union(edges.where("src <> dst").select("src", "dst", "w"))
    return _grid(g, k, _summed(rows, labels, k))


def wide(cells: DataFrame) -> DataFrame:
    """(id, embedding): the values of a vertex as one array by cluster."""
    ordered = F.sort_array(F.collect_list(F.struct("cluster", "value")))
    return cells.groupBy("id").agg(F.transform(ordered, lambda x: x["value"]).alias("embedding"))
