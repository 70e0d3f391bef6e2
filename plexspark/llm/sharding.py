"""Sharding (operator 10): a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns ``vnodes`` points of a ring of 2**32; a row lies at the hash of
its key and belongs to the next point clockwise. A shard takes as many rows as
its bound allows, rows beyond it continue clockwise to the next shard with room.
The bounds sum to the number of rows and differ by one at most, so balance is
exact (the law ``rows``); a shard more moves the rows on the arcs that its own
points cut off, and what overflows differently for them.

Only counts decide which part of an arc stays and which continues, so the walk
around the ring is planned on the driver over one number per arc (shards times
vnodes of them, whatever the number of rows); rows then find their place by
their rank in the arc. Rows of an arc are ranked by their place on the ring and
then by their contents, so the same table gives the same shards however it is
partitioned.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexspark.functions.order import numbered
from plexspark.llm import shared

RING = 1 << 32


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) by point; points depend on the shard and the vnode alone."""
    points = {}
    for s in range(shards):
        for v in range(vnodes):
            point = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=4).digest())
            points.setdefault(point, s)  # of two equal points the lower shard's stays
    return sorted(points.items())


def bounds(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def plan(counts: dict[int, int], owners: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, rank from, rank to, shard, slot of the first) for each part of an arc.

    In rounds: every arc offers its rows that have no place to the point they
    stand at; points take them in ring order up to their shard's bound, the rest
    move one point on. Rows of an arc keep their order, the first ones stay.
    """
    room = bounds(sum(counts.values()), shards)
    used = [0] * shards
    open_ = [(arc, 0, n, arc) for arc, n in sorted(counts.items()) if n]
    out = []
    while open_:
        moved = []
        for arc, lo, hi, at in open_:
            s = owners[at]
            take = min(hi - lo, room[s] - used[s])
            if take:
                out.append((arc, lo, lo + take, s, used[s]))
                used[s] += take
            if lo + take < hi:
                moved.append((arc, lo + take, hi, (at + 1) % len(owners)))
        open_ = sorted(moved, key=lambda x: (x[3], x[0], x[1]))
    return out


def arc_of(points: list[int]):
    """A column function: index of the first point at or after a position, 0 past the last."""
    at = np.array(points, np.int64)

    @F.pandas_udf("int")
    def arc(position: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, position.to_numpy(np.int64)) % len(at)).astype("int32")

    return arc


def assign(docs: DataFrame, shards: int = 16, vnodes: int = 64, key: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """A row for each row of ``docs``: the columns ``keep`` (else all), ``shard`` and gapless ``slot``.

    The position is the hash of ``key``, null included, which thus has a place
    of its own; rows that repeat a key, even a third of all rows, lie together
    and overflow clockwise, in the order of a hash of what is kept; rows that
    repeat all of that change places freely. Ranks come from one sort by ranges,
    which splits keys and repeated rows alike, so neither an arc nor a key meets
    in one task. An empty table gives an empty result. Columns ``shard``,
    ``slot`` and those whose names begin with ``_ring`` are replaced.
    """
    owners = ring(shards, vnodes)
    position = F.shiftrightunsigned(F.xxhash64(key), 32)
    keep = keep or {c: F.col(c) for c in docs.columns}
    keep = {n: c for n, c in keep.items() if n not in ("shard", "slot") and not n.startswith("_ring")}
    around = F.pmod(position - owners[-1][0] - 1, F.lit(RING))  # counted from behind the last point, where the first arc begins
    rows = docs.select(*(c.alias(n) for n, c in keep.items()), arc_of([p for p, _ in owners])(position).alias("_ring_arc"), around.alias("_ring_at"))
    rows = rows.withColumns({"_ring_what": F.xxhash64(*keep), "_ring_tie": F.monotonically_increasing_id()})
    ranked = numbered(shared.cut(rows), "_ring_at", "_ring_what", "_ring_tie", into="_ring_j")

    totals = {r[0]: r[1] for r in ranked.groupBy("_ring_arc").agg(F.count("*")).collect()}  # one row per arc at most
    starts = {arc: sum(n for a, n in totals.items() if a < arc) for arc in totals}
    parts = plan(totals, [s for _, s in owners], shards)  # at most arcs + shards rows: a part ends with its arc or fills a shard
    parts = [(arc, starts[arc] + lo, starts[arc] + hi, s, slot) for arc, lo, hi, s, slot in parts]
    planned = docs.sparkSession.createDataFrame(parts, "_ring_arc int, _ring_lo long, _ring_hi long, shard int, _ring_slot long")
    placed = ranked.join(F.broadcast(planned), "_ring_arc").where("_ring_j >= _ring_lo AND _ring_j < _ring_hi")
    return placed.select(*keep, "shard", (F.col("_ring_slot") + F.col("_ring_j") - F.col("_ring_lo")).alias("slot"))
