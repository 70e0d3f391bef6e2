"""Own algorithms: messages and updates of vertices, repeated until nothing changes."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexspark.operators.edge_map import Dealt, dealt, edge_map
from plexspark.plans.lineage import cut, cut_counted, cut_observed, drop, scratch

#: Rounds whose changes are kept apart at most before they are merged.
APART = 8


class State:
    """A vertex table (*keys, id, value) that changes: a table, and what has changed since, in tables of their own.

    What a round writes is in proportion to what changed in it; changes are
    merged into the table when they are as many as its rows, or many rounds old.
    """

    def __init__(self, first: DataFrame, keys: Sequence[str] = ()):
        self.by = [*keys, "id"]
        self.table, self.rows = cut_counted(first.select(*self.by, "value"))
        self.changes: list[DataFrame] = []
        self.fresh = 0

    def recent(self) -> DataFrame | None:
        """The last change of each vertex that has changed since the table was written."""
        if len(self.changes) < 2:
            return self.changes[0] if self.changes else None
        dated = [c.withColumn("_n", F.lit(n)) for n, c in enumerate(self.changes)]
        return functools.reduce(DataFrame.union, dated).groupBy(*self.by).agg(F.max_by("value", "_n").alias("value"))

    def joined(self, rows: DataFrame, into: str, on: str = "id") -> DataFrame:
        """``rows`` with the values of their vertices, null for those that have none."""
        by = [*self.by[:-1], on]
        out = rows.join(self.table.withColumnsRenamed({"id": on, "value": into}), by, "left")
        if (recent := self.recent()) is None:
            return out
        return out.join(recent.withColumnsRenamed({"id": on, "value": "_recent"}), by, "left").withColumn(into, F.coalesce("_recent", into)).drop("_recent")

    def whole(self) -> DataFrame:
        if (recent := self.recent()) is None:
            return self.table
        return self.table.join(recent, self.by, "left_anti").union(recent)

    def add(self, change: DataFrame, rows: int) -> None:
        self.changes.append(change.select(*self.by, "value"))
        self.fresh += rows
        if self.fresh > self.rows or len(self.changes) >= APART:
            old = [self.table]  # changes are the loop's tables
            self.table, self.rows = cut_counted(self.whole())
            self.changes, self.fresh = [], 0
            drop(*old)


def iterate(
    edges: DataFrame | Dealt,
    state: DataFrame,
    message: Column,
    combine: Callable[[Column], Column],
    update: Callable[[Column, Column], Column] | None = None,
    sends: Callable[[Column, Column], Column] | None = None,
    first: DataFrame | None = None,
    rounds: int | None = None,
    inward: bool = False,
    keys: Sequence[str] = (),
    jump: bool = False,
    check: Callable[[int, DataFrame, State], bool] | None = None,
) -> DataFrame | None:
    """(*keys, id, value): a fixpoint of messages along edges.

    ``state`` (id, value) holds the vertices that have a value at first. In each
    round the vertices that changed in the last one (in the first one ``first``,
    or all of ``state``) send ``message``, an expression over src, dst, weight
    and value, along their edges; ``combine`` aggregates what arrives at a
    vertex. ``update(old, new)`` is its next value, of the one it has (null if
    none) and what arrived; null, or the same again, leaves it as it is. None
    takes what arrives where there is no value yet. ``sends(old, next)`` tells
    which of the changed vertices send; all do without it. The loop ends when
    none sends, or after ``rounds``.

    ``keys`` (columns of ``state``) run several searches at once. ``jump`` says
    that a value is the id of a vertex whose own value could be sent on just as
    well: then values are also looked up at the vertices they name, so that long
    paths take a logarithmic number of rounds. ``check(round, sent,
    state)`` is called before a round; True ends the loop with None.

    Edges are moved once for all rounds; a round writes what changed. State and
    changes are tables, so a lost executor costs its tasks of one round.
    """
    if not isinstance(edges, Dealt):
        with dealt(edges, both=False) as own:
            return iterate(own, state, message, combine, update, sends, first, rounds, inward, keys, jump, check)
    update = update or (lambda old, new: F.when(old.isNull(), new))
    by = [*keys, "id"]
    with scratch() as keep:
        now = State(state, keys)
        sent, n = now.table if first is None else cut(first.select(*by, "value")), 0
        while rounds is None or n < rounds:
            n += 1
            if check and check(n, sent, now):
                return None
            got = edge_map(edges, sent, message, combine, inward=inward, keys=keys)
            if jump and n > 1:
                got = got.union(_named(now, sent, by)).groupBy(*by).agg(combine(F.col("value")).alias("value"))
            met = now.joined(got.withColumnRenamed("value", "_new"), "_old")
            met = met.withColumn("value", update(F.col("_old"), F.col("_new"))).where(F.col("value").isNotNull() & ~F.col("value").eqNullSafe(F.col("_old")))
            told = sends(F.col("_old"), F.col("value")) if sends else F.lit(True)
            change, seen = cut_observed(met.select(*by, "value", F.coalesce(told, F.lit(False)).alias("_sends")), rows=F.count(F.lit(1)), sends=F.count_if("_sends"))
            if seen["rows"]:
                now.add(change, seen["rows"])
            if not seen["sends"]:
                break
            sent = change.where("_sends").select(*by, "value")
        return keep(cut(now.whole()))


def _named(now: State, sent: DataFrame, by: list[str]) -> DataFrame:
    """What the changed vertices' values have for values, and the changes of vertices that others have for values."""
    keys, own = by[:-1], now.whole()
    of = lambda rows: rows.select(*keys, F.col("id").alias("value"), F.col("value").alias("_over"))
    both = sent.join(of(own), [*keys, "value"]).union(own.join(of(sent), [*keys, "value"]).select(*keys, "value", "id", "_over"))
    return both.select(*by, F.col("_over").alias("value"))
