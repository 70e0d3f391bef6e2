"""Quality rules (operator 3): zstandard compression bands.

A text that repeats itself compresses far better than prose of its length, a
text of random strings far worse. Both are judged on the whole text and on
fixed chunks of it, against limits that depend on the text's length, as short
texts of any kind compress worse.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from plexspark.llm import shared, words

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits on compressed bytes over bytes.

    ``limits`` has (least bytes, lowest, highest ratio) in ascending order; a
    text is held to the last entry that it is long enough for, one shorter than
    the first to none. Each chunk of ``chunk`` bytes is held to ``chunk_limits``
    in the same way, and the text fails if more than ``bad_chunks`` of its chunks do.
    """

    level: int = 3
    limits: tuple[tuple[int, float, float], ...] = ((100, 0.35, 1.15), (200, 0.30, 1.00), (400, 0.25, 0.85), (1600, 0.20, 0.75), (6400, 0.15, 0.70))
    chunk: int = 4096
    chunk_limits: tuple[tuple[int, float, float], ...] = ((1024, 0.15, 0.85), (4096, 0.15, 0.80))
    bad_chunks: float = 0.3


def band(size: int, limits: tuple[tuple[int, float, float], ...]) -> tuple[float, float]:
    low, high = 0.0, float("inf")
    for least, a, b in limits:
        if size >= least:
            low, high = a, b
    return low, high


def compression(text: bytes, bands: Bands, packer: zstandard.ZstdCompressor) -> tuple[float | None, float | None, bool]:
    """Ratio of the whole text, share of its chunks out of their band, and the verdict (true: passes)."""
    if not text:
        return None, None, True
    ratio = len(packer.compress(text)) / len(text)
    low, high = band(len(text), bands.limits)
    bad = total = 0
    for lo in range(0, len(text), bands.chunk):
        part = text[lo : lo + bands.chunk]
        a, b = band(len(part), bands.chunk_limits)
        total += 1
        if a > 0 or b < float("inf"):
            r = ratio if len(part) == len(text) else len(packer.compress(part)) / len(part)
            bad += not a <= r <= b
    share = bad / total
    return ratio, share, low <= ratio <= high and share <= bands.bad_chunks


def repeated_words(buf: np.ndarray, w: words.Words, size: int = WINDOW) -> np.ndarray:
    """For each row, its words in windows of ``size`` words that the row has twice or more."""
    begin = words.window_starts(w, size)
    if not len(begin):
        return np.zeros(len(w.counts), np.int64)
    each = words.span_hashes(buf, w.start, w.end)
    keys = words.mix(words.run_hashes(each, size)[begin] ^ words.mix(w.doc[begin], 7))
    inside = words.covered(begin[words.repeated(keys)], size, len(w.doc))
    return words.row_sums(inside, w.first)


def duplicate_lines(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each row, its lines that have a word and equal an earlier line of the row."""
    ends = np.union1d(np.flatnonzero(buf == 10), at[1:])
    starts = np.union1d(np.flatnonzero(buf == 10) + 1, at[:-1])
    bounds = np.union1d(starts, ends)  # a newline byte is a span of its own between an end and a start
    lo, hi = bounds[:-1], bounds[1:]
    visible = np.zeros(len(buf) + 1, np.int64)
    np.cumsum(~words.SPACE[buf], out=visible[1:])
    keep = visible[hi] > visible[lo]
    lo, hi = lo[keep], hi[keep]
    doc = np.searchsorted(at, lo, side="right") - 1
    keys = words.mix(words.span_hashes(buf, lo, hi) ^ words.mix(doc, 7))
    n = len(at) - 1
    first = np.unique(keys, return_index=True)[1]
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, zstd_ratio double, bad_chunk_share double, base_failed boolean, kept boolean"


def measures(buf: np.ndarray, at: np.ndarray, bands: Bands, packer: zstandard.ZstdCompressor) -> dict[str, list | np.ndarray]:
    """The columns of SCHEMA for the rows of a pass."""
    w = words.words_of(buf, at)
    n = w.counts
    chars = words.row_sums(((buf & 0xC0) != 0x80) & ~words.SPACE[buf], at)
    again = repeated_words(buf, w)
    raw = buf.tobytes()
    packed = [compression(raw[a:b], bands, packer) for a, b in zip(at[:-1], at[1:], strict=True)]
    failed = (n < 20) | (100 * again > 30 * n)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": words.row_sums(SYMBOLS[buf], at), "n_dup_lines": duplicate_lines(buf, at), "n_repeat_words": again,
        "zstd_ratio": [x[0] for x in packed], "bad_chunk_share": [x[1] for x in packed], "base_failed": failed, "kept": ~failed & np.array([x[2] for x in packed], bool),
    }


def quality(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """``docs`` with one more column ``quality``, a struct of SCHEMA.

    Each row is judged alone, in one pass without a shuffle: the struct counts
    words, symbols, repeated lines and repeated 8-word windows, and holds the
    compression ratios. ``base_failed``: under 20 words, or over 30 % of the
    words in repeated windows. ``kept``: not base_failed and inside the bands.
    A null or empty text has no words, null ratios, and fails; repeated rows
    get equal results; an empty table stays empty. A column ``quality`` of the
    input is replaced, every other column is passed on as it is.
    """
    docs = docs.drop("quality")
    out = StructType([*docs.schema.fields, StructField("quality", StructType.fromDDL(SCHEMA))])
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            for part, buf, at in shared.passes(batch, text):
                cols = measures(buf, at, bands, packer)
                struct = pa.StructArray.from_arrays([pa.array(v) if isinstance(v, np.ndarray) else pa.array(v, pa.float64()) for v in cols.values()], list(cols))
                yield pa.RecordBatch.from_arrays([*part.columns, struct], [*names, "quality"])

    return docs.mapInArrow(run, out)
