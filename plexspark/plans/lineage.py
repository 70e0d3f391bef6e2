"""Cutting lineage: steps that are written down, so that later ones start from files."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_path: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()
_inside: ContextVar[set[str] | None] = ContextVar("inside", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where none is named, a temporary one, on one machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Later jobs start from files that every executor sees, so neither lineage
    nor estimates of sizes grow with the steps before, and a lost executor
    costs the tasks it ran. The tables go when they are dropped (``drop``), at
    the latest when the program ends (``sweep``).
    """
    spark = df.sparkSession
    path = place(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _path[out] = path
    return out


def place(spark: SparkSession) -> str:
    """A new path in the shared folder, for files that go as tables of ``cut`` do."""
    path = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    _written[path] = spark
    if (inside := _inside.get()) is not None:
        inside.add(path)
    return path


def cut_observed(df: DataFrame, **totals: Column) -> tuple[DataFrame, dict]:
    """``cut`` and aggregates over the rows, taken as they are written."""
    seen = Observation()
    out = cut(df.observe(seen, *(c.alias(name) for name, c in totals.items())))
    return out, seen.get


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows."""
    out, seen = cut_observed(df, rows=F.count(F.lit(1)))
    return out, seen["rows"]


def drop(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more; other frames are left alone."""
    for df in tables:
        _delete(_path.pop(df, None))


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that ``cut`` makes inside, in this thread, go at the end, but for those given to the function it yields."""
    outer, made, kept = _inside.get(), set(), set()
    token = _inside.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(_path[df])
        return df

    try:
        yield keep
    finally:
        _inside.reset(token)
        for path in made - kept:
            _delete(path)
        if outer is not None:
            outer |= kept


def _delete(path: str | None) -> None:
    if path in _written:
        spark = _written.pop(path)
        with suppress(Py4JError, OSError, AttributeError):  # a session that has ended can't delete any more
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """``df`` persisted for as long as a loop reads it; blocks of a lost executor are computed again."""
    kept = df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


@atexit.register
def sweep() -> None:
    """Delete the tables of ``cut``; frames that rest on them can't be computed any more."""
    for path in list(_written):
        _delete(path)
