"""The two operators that analytics are made of: along edges, and over vertex sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexspark.plans.lineage import cut, cut_counted, drop, held

#: Edges that leave a vertex beyond which they are dealt to several partitions.
HUB = 1 << 20


@dataclass
class Dealt:
    """Edges held by one end (``by``) and sorted by it; those of hubs (``by``, parts) are dealt to parts, which their senders are copied to."""

    edges: DataFrame
    hubs: DataFrame | None
    by: str = "src"
    back: Dealt | None = None  #: the same edges by the other end

    def sending(self, frontier: DataFrame) -> tuple[DataFrame, list[str]]:
        """The frontier as (_from, [part], ...), and by what it is joined beside the vertex."""
        if self.hubs is None:
            return frontier.withColumnRenamed("id", "_from"), []
        parts = frontier.join(self.hubs.withColumnRenamed(self.by, "id"), "id", "left")
        copies = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
        return parts.withColumn("_part", copies).drop("parts").withColumnRenamed("id", "_from"), ["_part"]


def hubs_of(edges: DataFrame, by: str) -> tuple[DataFrame, int]:
    """(``by``, parts) of the hubs at that end, a table, and how many there are."""
    return cut_counted(edges.groupBy(by).agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")).where("parts > 1"))


def parted(edges: DataFrame, hubs: DataFrame, by: str) -> DataFrame:
    """Edges with the part of their hub that they are dealt to, 0 without one."""
    other = "dst" if by == "src" else "src"
    part = F.pmod(F.xxhash64(other), F.coalesce("parts", F.lit(1))).cast("int")
    return edges.join(hubs, by, "left").withColumn("part", part).drop("parts")


@contextmanager
def laid(edges: DataFrame, by: str) -> Iterator[Dealt]:
    """Edges of a table partitioned and sorted by one end, and held while they are used."""
    hubs, found = hubs_of(edges, by)
    key = [by, "part"] if found else [by]
    spread = parted(edges, hubs, by) if found else edges
    with held(spread.repartition(*key).sortWithinPartitions(*key)) as kept:
        yield Dealt(kept, hubs if found else None, by)
    drop(hubs)


@contextmanager
def dealt(edges: DataFrame, both: bool = False) -> Iterator[Dealt]:
    """Edges for loops that send along them: written once, partitioned and sorted by src, held while the loop runs.

    A round then joins its frontier without moving or sorting edges. ``both``
    holds them by dst as well, for loops that also go against the edges. A hub,
    with more than ``HUB`` edges at that end, has them spread by a hash of their
    other ends, so that no partition and no task grows with the largest degree;
    hubs are a small table, and how it is joined is decided from its size.
    """
    base = cut(edges)
    with ExitStack() as stack:
        out = stack.enter_context(laid(base, "src"))
        if both:
            out.back = stack.enter_context(laid(base, "dst"))
        yield out
    drop(base)


def edge_map(
    edges: DataFrame | Dealt,
    frontier: DataFrame | None,
    message: Column,
    combine: Callable[[Column], Column],
    cond: DataFrame | None = None,
    inward: bool = False,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Messages along the edges that leave a frontier, combined where they arrive: (*keys, id, value).

    ``message`` is an expression over src, dst, weight and the frontier's other
    columns. ``frontier`` (id, ...) is joined with the edges' tail; None stands
    for all vertices, and then there is no join. ``combine`` is any aggregate;
    Spark applies its own before the exchange as well as after, a grouped pandas
    UDF, for what Spark's functions can't say, after it. Vertices in ``cond``
    (*keys, id) take part as receivers only if they are not in it: an anti-join
    before the aggregate. ``inward`` goes against the edges. ``keys`` are columns
    of the frontier that keep several searches apart. Whether a small frontier
    is broadcast or exchanged is decided at run time, from its size.
    """
    tail, head = ("dst", "src") if inward else ("src", "dst")
    own = edges.back or edges if inward and isinstance(edges, Dealt) else edges
    rows = own.edges if isinstance(own, Dealt) else own
    if frontier is not None:
        sent, by = own.sending(frontier) if isinstance(own, Dealt) and own.by == tail else (frontier.withColumnRenamed("id", "_from"), [])
        on = F.col(tail) == F.col("_from")
        rows = rows.join(sent, on & (F.col("part") == F.col("_part")) if by else on)
    rows = rows.select(*keys, F.col(head).alias("id"), message.alias("value"))
    if cond is not None:
        rows = rows.join(cond.select(*keys, "id"), [*keys, "id"], "left_anti")
    return rows.groupBy(*keys, "id").agg(combine(F.col("value")).alias("value"))


def vertex_map(vertices: DataFrame, update: dict[str, Column] | None = None, keep: Column | None = None) -> DataFrame:
    """New values for the members of a vertex set, and those of them that satisfy ``keep``: a projection and a filter."""
    out = vertices.withColumns(update) if update else vertices
    return out if keep is None else out.where(keep)
