"""Triangles and common neighbours.

An edge is turned towards the end of the higher id, or of the higher degree where
an end has many neighbours, so that no vertex has more than a small multiple of
the square root of the number of edges to leave by; a triangle then is an edge
and a vertex that both its ends lead to.

Lists of neighbours meet in cells. Vertices are cut into blocks by ranges of ids,
of which a task can hold the lists; a vertex's list goes once to each block that
it has a neighbour in, not once to each neighbour, and is looked up there without
a further exchange. Each block is met by several parts of the vertices, so there
are more cells than blocks.
"""

from __future__ import annotations

from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexspark.plans.lineage import cut, cut_counted, cut_observed, drop

#: Bytes of lists that a task holds, about; cells at least, and edges that are worth one; neighbours beyond which a vertex may be one of many.
HELD, CELLS, WORTH, MANY = 1 << 27, 32, 1 << 14, 1 << 10
#: Edges that block bounds are drawn from, about, as those of Spark's range partitioning are.
DRAWN = 1 << 20


class Cells:
    """Blocks of ids, each met by ``spread`` parts of the vertices."""

    def __init__(self, lists: DataFrame, edges: int, most: int):
        """For the lists of ``lists`` (owner, member), a row a member; ids are ``most`` at most."""
        self.kind, size = ("int", 4) if most < 1 << 31 else ("long", 8)
        cells = max(1, min(CELLS, edges // WORTH))
        blocks = max(ceil(1.5 * edges * size / HELD), isqrt(cells))
        self.bounds = []
        if blocks > 1:
            drawn = lists.where(F.pmod(F.xxhash64("owner", "member"), F.lit(max(1, edges // DRAWN))) == 0)
            weighed = drawn.select(F.explode(F.array("owner", "owner", "owner", "member")).alias("id"))  # lists are held, members asked for
            found = weighed.agg(F.percentile_approx("id", [n / blocks for n in range(1, blocks)], 10 * blocks + 1000)).first()[0]
            self.bounds = sorted(set(found or []))
        self.blocks = len(self.bounds) + 1
        self.spread = max(1, cells // self.blocks)

    def block(self, x: Column) -> Column:
        def among(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(x <= F.lit(self.bounds[mid]), among(low, mid)).otherwise(among(mid + 1, high))

        return among(0, self.blocks - 1)

    def meet(self, rows: DataFrame, lists: DataFrame, asked: str, how: str = "inner") -> DataFrame:
        """(a, b, own, other): ``rows`` (a, own, block, ...) with each member b of its column ``asked`` in that block, and the list of b among ``lists`` (id, list)."""
        number = lambda block, part: block * self.spread + part
        dealt = lambda df: df.repartitionById(self.blocks * self.spread, F.col("cell"))
        part = F.pmod(F.xxhash64("a"), F.lit(self.spread)).cast("int")
        names = dict.fromkeys(["a", "own", asked])
        sent = dealt(rows.select(number(F.col("block"), part).alias("cell"), *names))
        sent = sent.select("cell", "a", "own", F.explode(asked).alias("b")).withColumn("b", F.col("b").cast("long"))
        sent = sent.where(self.block(F.col("b")) == F.expr(f"cell div {self.spread}"))
        copies = F.explode(F.sequence(F.lit(0), F.lit(self.spread - 1)))
        kept = lists.select(F.col("id").alias("b"), F.col("list").alias("other"), copies.alias("part"))
        kept = dealt(kept.select(number(self.block(F.col("b")), F.col("part")).alias("cell"), "b", "other"))
        return sent.join(kept.hint("shuffle_hash"), ["cell", "b"], how).select("a", "b", "own", "other")


def _counted(degree: DataFrame) -> tuple[DataFrame, dict]:
    """``degree`` (id, d) as a table; how many rows it has, the sum of d and the greatest id."""
    return cut_observed(degree, rows=F.count(F.lit(1)), total=F.coalesce(F.sum("d"), F.lit(0)), most=F.coalesce(F.max("id"), F.lit(0)))


def _limit(seen: dict) -> int:
    return max(MANY, 4 * seen["total"] // max(1, seen["rows"]))


def _met(g) -> tuple[DataFrame, DataFrame]:
    """(a, b, common) for each turned edge with the vertices that both ends lead to; and (id, d): degrees."""
    edges = g.edges.select("src", "dst").where("src <> dst")
    if g.directed:
        edges = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    once = cut(edges.where("src < dst"))
    degree, seen = _counted(once.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("d")))
    many, found = cut_counted(degree.where(F.col("d") > _limit(seen)))
    turned = once.select(F.col("src").alias("owner"), F.col("dst").alias("member"))
    if found:
        of = lambda end, d: many.select(F.col("id").alias(end), F.col("d").alias(d))
        both = once.join(of("src", "a"), "src", "left").join(of("dst", "b"), "dst", "left")
        forward = F.coalesce("a", F.lit(0)) <= F.coalesce("b", F.lit(0))
        turned = both.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("owner"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("member"))
    cells = Cells(turned, seen["total"] // 2, seen["most"])
    lists = cut(turned.groupBy("owner").agg(F.collect_list(F.col("member").cast(cells.kind)).alias("list"), F.collect_set(cells.block(F.col("member"))).alias("blocks")))
    drop(once, many)
    rows = lists.select(F.col("owner").alias("a"), F.col("list").alias("own"), F.explode("blocks").alias("block"))
    met = cells.meet(rows, lists.select(F.col("owner").alias("id"), "list"), "own")
    return met.select("a", "b", F.array_intersect("own", "other").alias("common")), degree


def count(g) -> DataFrame:
    """One row (triangles); the graph is taken as undirected and without loops. Lists of neighbours are written at once."""
    return _met(g)[0].agg(F.coalesce(F.sum(F.size("common").cast("long")), F.lit(0)).alias("triangles"))


def per_vertex(g) -> DataFrame:
    """(id, triangles, clustering): the triangles each vertex is a corner of, and their share of its pairs of neighbours (0 with fewer than two).

    Each triangle is found once and credits its three corners, which are summed
    before they are exchanged; the graph is taken as undirected and without loops.
    """
    met, degree = _met(g)
    size = F.size("common").cast("long")
    corner = lambda who, n: F.struct(who.cast("long").alias("id"), n.alias("n"))
    ends = F.array(corner(F.col("a"), size), corner(F.col("b"), size))
    credits = met.where(F.size("common") > 0).select(F.explode(F.concat(ends, F.transform("common", lambda x: corner(x, F.lit(1).cast("long"))))).alias("c"))
    found = credits.groupBy("c.id").agg(F.sum("c.n").alias("triangles"))
    out = g.vertices.join(degree, "id", "left").join(found, "id", "left")
    triangles, d = F.coalesce("triangles", F.lit(0)), F.col("d")
    return out.select("id", triangles.alias("triangles"), F.when(d > 1, 2 * triangles / (d * (d - 1))).otherwise(0.0).alias("clustering"))


def common_neighbors(g, pairs: DataFrame) -> DataFrame:
    """(a, b, common) for ``pairs`` (a, b): neighbours of both that are less than both.

    Lists of lesser neighbours meet in cells. A pair with an end that has many
    neighbours, or is asked for with many others, goes by rows: its end of lower
    degree is expanded.
    """
    asked = pairs.select(F.col("a").cast("long"), F.col("b").cast("long"))
    edges = g.edges.select("src", "dst")
    degree, seen = _counted(edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("d")))
    often = asked.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("d"))
    many, found = cut_counted(degree.union(often).where(F.col("d") > _limit(seen)).where("id IS NOT NULL").select("id").distinct())
    less = edges.where("dst < src").select(F.col("src").alias("owner"), F.col("dst").alias("member"))
    few, whole = asked.where("a IS NOT NULL AND b IS NOT NULL"), asked.where("a IS NULL OR b IS NULL").distinct().withColumn("common", F.lit(0).cast("long"))
    if found:
        marked = few
        for end in "ab":
            marked = marked.join(many.select(F.col("id").alias(end), F.lit(True).alias(f"_{end}")), end, "left")
        heavy = F.col("_a").isNotNull() | F.col("_b").isNotNull()
        whole = whole.union(_by_rows(edges, degree, marked.where(heavy).select("a", "b").distinct()))
        few = marked.where(~heavy).select("a", "b")
        less = less.join(many.select(F.col("id").alias("owner")), "owner", "left_anti")
    cells = Cells(less, seen["total"], seen["most"])
    lists = cut(less.groupBy(F.col("owner").alias("id")).agg(F.collect_list(F.col("member").cast(cells.kind)).alias("list")))
    groups = few.repartition("a").groupBy("a", cells.block(F.col("b")).alias("block")).agg(F.collect_set("b").alias("others"))
    rows = groups.join(lists.select(F.col("id").alias("a"), F.col("list").alias("own")), "a", "left")
    met = cells.meet(rows, lists, "others", "left")
    counted = F.when(F.col("own").isNull() | F.col("other").isNull(), 0).otherwise(F.size(F.array_intersect("own", "other")))
    return met.select("a", "b", counted.cast("long").alias("common")).union(whole)


def _by_rows(edges: DataFrame, degree: DataFrame, asked: DataFrame) -> DataFrame:
    """(a, b, common) by a row for each lesser neighbour of the end of lower degree."""
    both = asked.join(degree.select(F.col("id").alias("a"), F.col("d").alias("of_a")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("of_b")), "b")
    turned = F.col("of_b") < F.col("of_a")
    both = both.select("a", "b", F.when(turned, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("then"))
    seen = both.join(edges.withColumnRenamed("dst", "x"), "src").where(F.col("x") < F.least("a", "b")).select("a", "b", "then", "x")
    seen = seen.join(edges.select(F.col("src").alias("then"), F.col("dst").alias("x")), ["then", "x"], "left_semi")
    counted = seen.groupBy("a", "b").agg(F.count("*").alias("common"))
    return asked.join(counted, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"))
