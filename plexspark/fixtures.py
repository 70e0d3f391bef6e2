"""Graphs derived from the relational tables, for queries, tests and the bench."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexspark.graph import Graph


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight), src < dst: parts that share an order; the weight tells how far their quantities are apart. Lines are exchanged once for both sides."""
    a = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity").repartition("l_orderkey")
    b = a.select("l_orderkey", F.col("l_partkey").alias("dst"), F.col("l_quantity").alias("q"))
    rows = a.join(b, "l_orderkey").where("l_partkey < dst")
    return rows.select(F.col("l_partkey").alias("src"), "dst", (F.abs(F.col("l_quantity") - F.col("q")).cast("int") + 1).alias("weight"))


def parts(spark: SparkSession, sf_dir: str, weighted: bool = False) -> Graph:
    edges = parts_edges(spark, sf_dir)
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"))
    return Graph.from_edges(edges if weighted else edges.select("src", "dst"), ids)


def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five classes of parts by size; the largest sizes are unknown."""
    label = F.when(F.col("p_size") > 40, F.lit(-1)).otherwise(F.col("p_size") % 5)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), label.cast("int").alias("label"))


def suppliers(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts and suppliers (ids after those of parts): bipartite."""
    n = table(spark, sf_dir, "part").count()
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + n).alias("dst"))
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")).union(table(spark, sf_dir, "supplier").select(F.col("s_suppkey") + n))
    return Graph.from_edges(edges, ids)


def customer_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight): the customer of an order and that of the next; order keys are dense, so the next is found by a join."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") / 1000).cast("int").alias("weight"))
    after = o.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_custkey").alias("dst"))
    return o.join(after, "o_orderkey").select(F.col("o_custkey").alias("src"), "dst", "weight")


def customers(spark: SparkSession, sf_dir: str, directed: bool = True, weighted: bool = False, drop_self_loops: bool = True) -> Graph:
    edges = customer_steps(spark, sf_dir)
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return Graph.from_edges(edges if weighted else edges.select("src", "dst"), ids, directed, drop_self_loops)


def customer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("int").alias("label"))


def orders(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and their orders (ids after those of customers): a star each."""
    n = table(spark, sf_dir, "customer").count()
    o = table(spark, sf_dir, "orders")
    edges = o.select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + n).alias("dst"))
    ids = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).union(o.select(F.col("o_orderkey") + n))
    return Graph.from_edges(edges, ids)
