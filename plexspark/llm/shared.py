"""What the operators share: reading tables, cutting lineage, walking Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plexspark.plans import lineage

#: Text bytes that one numpy pass holds; a longer single text is a pass of its own.
PASS_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


cut, drop, scratch = lineage.cut, lineage.drop, lineage.scratch


def orderly(column: str) -> Column:
    """An id that may be null as (none, value), which can be compared, joined and sorted: null comes last."""
    own = F.col(column).cast("long")
    return F.struct(own.isNull().alias("none"), F.coalesce(own, F.lit(0).cast("long")).alias("value"))


#: A key with more than one in so many rows is joined by broadcast.
HOT = 4096


def join_counted(rows: DataFrame, counts: DataFrame, key: str, count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``counts`` (a row for each key; a table), whose ``count`` says how many of ``rows`` have the key at most.

    Keys that hold a large share of all rows are joined where they lie, by a
    broadcast of at most ``2 * HOT`` rows, and only the others are exchanged.
    """
    limit = counts.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0] // HOT
    hot, cold = counts.where(F.col(count) > limit), counts.where(F.col(count) <= limit)
    apart = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key, "inner" if how == "left" else how).union(apart.join(cold, key, how))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its offsets (one more than rows); null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def passes(batch: pa.RecordBatch, text: str = "text", limit: int = PASS_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about ``limit`` text bytes each, with their bytes and offsets."""
    if not batch.num_rows:
        return
    buf, at = text_bytes(batch.column(batch.schema.get_field_index(text)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, batch.num_rows)
        yield batch.slice(lo, hi - lo), buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
