"""Numbering rows in an order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexspark.plans.lineage import cut


def numbered(df: DataFrame, *order: str, into: str = "j") -> DataFrame:
    """``df`` with its rank (``into``, from 0) in that order: sorted by ranges, counted per range, summed over ranges; columns ``_order_*`` are its own."""
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_order_n", F.monotonically_increasing_id()))
    ranged = ranged.withColumn("_order_part", F.shiftright("_order_n", 33)).withColumn("_order_row", F.col("_order_n").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = ranged.groupBy("_order_part").agg(F.count("*").alias("size"))
    earlier = F.sum("size").over(Window.orderBy("_order_part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    sizes = sizes.select("_order_part", F.coalesce(earlier, F.lit(0)).alias("_order_before"))
    ranked = ranged.join(sizes, "_order_part").withColumn(into, F.col("_order_before") + F.col("_order_row"))
    return ranked.drop("_order_part", "_order_row", "_order_n", "_order_before")
