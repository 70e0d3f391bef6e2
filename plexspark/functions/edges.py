"""Rules that make an edge list an edge set."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_weighted(edges: DataFrame) -> bool:
    return "weight" in edges.columns


def typed(edges: DataFrame) -> DataFrame:
    """(src, dst[, weight]) as bigint, bigint[, int]; rows that lack an end are left out, a missing weight is 1."""
    out = edges.where("src IS NOT NULL AND dst IS NOT NULL")
    cols = [F.col("src").cast("long"), F.col("dst").cast("long")]
    if is_weighted(edges):
        cols.append(F.coalesce(F.col("weight").cast("int"), F.lit(1)).alias("weight"))
    return out.select(*cols)


def without_loops(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src") != F.col("dst"))


def deduplicate(edges: DataFrame, keep: str = "min") -> DataFrame:
    """One row for each (src, dst); of several weights the least or the greatest stays."""
    if not is_weighted(edges):
        return edges.select("src", "dst").distinct()
    pick = {"min": F.min, "max": F.max}[keep]
    return edges.groupBy("src", "dst").agg(pick("weight").alias("weight"))


def reverse(edges: DataFrame) -> DataFrame:
    rest = ["weight"] if is_weighted(edges) else []
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, each once; of several weights the least stays. An edge is exchanged once, lower end first, and turned after that."""
    rest = ["weight"] if is_weighted(edges) else []
    once = deduplicate(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *rest), "min")
    way = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    ways = F.when(F.col("src") == F.col("dst"), F.array(way("src", "dst"))).otherwise(F.array(way("src", "dst"), way("dst", "src")))
    return once.select(F.explode(ways).alias("way"), *rest).select("way.*", *rest)


def significant(x: Column, digits: int = 6) -> Column:
    """A number as text with so many significant digits, without trailing zeros, as C++ streams print it."""

    @F.pandas_udf("string")
    def printed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f"%.{digits}g" % v)

    return F.when(x.isNotNull(), printed(x.cast("double")))


def decimals(row: Column, digits: int = 6) -> Column:
    """An array of numbers as text, each with so many decimals as C prints them: halves go by the exact binary value, where Spark's functions round its shortest digits up."""

    @F.pandas_udf("string")
    def printed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda values: " ".join([f"%.{digits}f" % v for v in values]))

    return printed(row)
