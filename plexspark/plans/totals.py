"""One-pass totals: degrees and checksums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def degrees(g, inward: bool = False) -> DataFrame:
    """(id, degree): edges that leave (or enter) each vertex, 0 for isolated ones."""
    own = g.edges.groupBy(F.col("dst" if inward else "src").alias("id")).agg(F.count("*").alias("degree"))
    return g.vertices.join(own, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def touching(g) -> DataFrame:
    """(id, degree): weights of all entries that touch a vertex, a loop once, for the vertices that have any; an undirected edge is two entries."""
    e = g.edges if g.weighted else g.edges.withColumn("weight", F.lit(1))
    ends = F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst"))
    return e.select(F.explode(ends).alias("id"), "weight").groupBy("id").agg(F.sum(F.col("weight").cast("long")).alias("degree"))


def weighted_degrees(g) -> DataFrame:
    """(id, degree): as ``touching``, 0 for isolated vertices."""
    return g.vertices.join(touching(g), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


def touch_all(g) -> DataFrame:
    """One row (total): the sum of src over all edges."""
    return g.edges.agg(F.coalesce(F.sum("src"), F.lit(0)).alias("total"))


def edge_checksum(g, order: DataFrame) -> DataFrame:
    """One row (total): the sum of dst over the edges of the listed vertices, as often as they are listed."""
    times = order.groupBy(F.col("id").alias("src")).agg(F.count("*").alias("times"))
    rows = g.edges.join(times, "src")
    return rows.agg(F.coalesce(F.sum(F.col("dst") * F.col("times")), F.lit(0)).alias("total"))
