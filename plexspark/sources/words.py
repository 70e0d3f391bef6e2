"""The words of text files, told apart by blanks, read in byte ranges: a data source in Python.

    spark.dataSource.register(WordSource)
    spark.read.format("blank_words").option("path", path).load()      # (block, i, word)

However lines break, a file is cut into ranges of bytes; a word belongs to the
range in which it starts, and is the i-th (from 0) there. Ranges are numbered in
the order of the files and their bytes, so the place of a word in the whole is
i and the number of words in all ranges before.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and of what is read at once.
RANGE, READ = 64 << 20, 4 << 20
BLANKS = b" \t\r\n\x00"


class Range(InputPartition):
    def __init__(self, number: int, path: str, start: int, end: int):
        super().__init__(number)
        self.number, self.path, self.start, self.end = number, path, start, end


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    address = urlparse(path)
    if address.scheme in ("", "file"):
        return pafs.LocalFileSystem(), address.path
    return pafs.FileSystem.from_uri(path)


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the part files of a folder in order."""
    system, inside = store(path)
    info = system.get_file_info(inside)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [(inside, info.size)]
    found = system.get_file_info(pafs.FileSelector(inside))
    return sorted((f.path, f.size) for f in found if f.type == pafs.FileType.File and not f.base_name.startswith(("_", ".")))


class WordReader(DataSourceReader):
    def __init__(self, path: str, size: int):
        self.path, self.size = path, size

    def partitions(self) -> list[Range]:
        spans = [(path, at, min(at + self.size, size)) for path, size in files(self.path) for at in range(0, size, self.size)]
        return [Range(n, *span) for n, span in enumerate(spans)] or [Range(0, "", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        count = 0
        for found in ranged(self.path, partition.path, partition.start, partition.end):
            names = ["block", "i", "word"]
            yield pa.RecordBatch.from_arrays([pa.array([partition.number] * len(found), pa.int64()), pa.array(range(count, count + len(found)), pa.int64()), pa.array([w.decode("utf-8", "replace") for w in found], pa.string())], names)
            count += len(found)


def ranged(address: str, path: str, start: int, end: int) -> Iterator[list[bytes]]:
    """The words that start in bytes [start, end) of a file, some at a time."""
    if start >= end:
        return
    system, _ = store(address)
    blank = bytes.maketrans(BLANKS, b" " * len(BLANKS))
    with system.open_input_file(path) as f:
        at = max(0, start - 1)  # the byte before tells whether a word goes on
        f.seek(at)
        rest, inside = b"", start > 0
        while at < end:
            data = f.read(min(READ, end - at))
            if not data:
                break
            at += len(data)
            data = data.translate(blank)
            if inside:  # a word of the range before
                cut = data.find(b" ")
                if cut < 0:
                    continue
                data, inside = data[cut:], False
            data = rest + data
            cut = data.rfind(b" ") + 1
            rest = data[cut:]
            if found := data[:cut].split():
                yield found
        while rest and not inside:  # the last word may end in the next range
            data = f.read(256)
            cut = data.translate(blank).find(b" ")
            rest += data if cut < 0 else data[:cut]
            if cut >= 0 or not data:
                yield [rest]
                break


class WordSource(DataSource):
    """Options: path, and range, the bytes of a partition."""

    @classmethod
    def name(cls) -> str:
        return "blank_words"

    def schema(self) -> str:
        return "block long, i long, word string"

    def reader(self, schema) -> WordReader:
        return WordReader(self.options["path"], int(self.options.get("range", RANGE)))


def readable(path: str) -> bool:
    """Whether the path is in a store that Python's readers know, and no pattern; others only Spark's read."""
    if set(path) & set("*?[{"):
        return False
    try:
        store(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, ImportError, OSError):
        return False
    return True


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WordSource)
