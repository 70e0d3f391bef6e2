"""Edges that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plexspark.functions import edges as rules
from plexspark.graph import Graph


def ingest(stream: DataFrame, path: str, checkpoint: str, directed: bool = False, drop_self_loops: bool = True) -> StreamingQuery:
    """Append the stream's edges (src, dst[, weight]) to a table, normalised batch by batch.

    A batch lands in a folder of its own number, overwritten if the batch runs
    again, so an edge is there once whatever fails. ``load`` merges batches.
    """
    def put(batch: DataFrame, number: int) -> None:
        own = rules.typed(batch)
        own = rules.without_loops(own) if drop_self_loops else own
        own = rules.deduplicate(own, "max") if directed else rules.symmetrize(own)
        own.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def load(spark: SparkSession, path: str, vertices: DataFrame | int | None = None, directed: bool = False) -> Graph:
    """The graph of all batches; an edge's weight is that of its latest batch."""
    rows = spark.read.parquet(path)
    if "weight" in rows.columns:
        rows = rows.groupBy("src", "dst").agg(F.max_by("weight", "batch").alias("weight"))
    else:
        rows = rows.select("src", "dst").distinct()
    return Graph.from_edges(rows, vertices, directed, drop_self_loops=False)


def distinct_edges(stream: DataFrame) -> DataFrame:
    """Each edge (src, dst) of a stream once, however often it comes: those seen are kept as keyed state.

    State grows with the edges (put it into RocksDB for large graphs); a batch
    costs what it brings, and tables appended to need no merging when loaded.
    """
    return rules.typed(stream).select("src", "dst").dropDuplicates(["src", "dst"])


def degree_counts(stream: DataFrame) -> DataFrame:
    """Running counts (id, edges) of the edges that a stream sends from each vertex, repeats included; write it in update mode."""
    return stream.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("edges"))


def degrees(stream: DataFrame) -> DataFrame:
    """Running out-degrees (id, degree) of a stream; an edge that comes again counts once. Write it in complete or update mode."""
    return distinct_edges(stream).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def compact(spark: SparkSession, path: str, into: str, directed: bool = False) -> None:
    """Batches of ``ingest`` merged into one at another place, as the first of what follows: loading it costs no history."""
    own = load(spark, path, directed=directed).edges
    own.write.mode("overwrite").parquet(f"{into}/batch=-1")
