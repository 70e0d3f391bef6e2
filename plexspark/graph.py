"""A graph: a vertex table and an edge set, both DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexspark.functions import edges as rules


class Graph:
    """``vertices`` (id) and ``edges`` (src, dst[, weight]), normalised.

    An undirected graph holds both directions of every edge. Analytics are
    methods that return DataFrames; nothing is computed before their first loop
    or the caller's action.
    """

    def __init__(self, vertices: DataFrame, edges: DataFrame, directed: bool = False):
        self.vertices, self.edges, self.directed = vertices, edges, directed

    @classmethod
    def from_edges(cls, edges: DataFrame, vertices: DataFrame | int | None = None, directed: bool = False, drop_self_loops: bool | None = None) -> Graph:
        """A graph of an edge list, which may repeat edges.

        Undirected: both directions are made, the least of several weights
        stays, and loops go unless asked for. Directed: the greatest weight
        stays, and loops stay unless they are to be dropped. ``vertices`` is a
        table (id), a number n for 0 to n - 1, or None for the edges' ends.
        """
        own = rules.typed(edges)
        if not directed if drop_self_loops is None else drop_self_loops:
            own = rules.without_loops(own)
        own = rules.deduplicate(own, "max") if directed else rules.symmetrize(own)
        if isinstance(vertices, int):
            vertices = edges.sparkSession.range(vertices)
        elif vertices is None:
            vertices = own.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        else:
            vertices = vertices.select(F.col("id").cast("long")).where("id IS NOT NULL").distinct()
        return cls(vertices, own, directed)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def weighted(self) -> bool:
        return rules.is_weighted(self.edges)

    def num_nodes(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        return self.edges.count()

    def require(self, vertex: int) -> None:
        if self.vertices.where(F.col("id") == vertex).isEmpty():
            raise ValueError(f"vertex {vertex} is not in the graph")

    def unweighted(self) -> Graph:
        return Graph(self.vertices, self.edges.select("src", "dst"), self.directed)

    def settled(self) -> Graph:
        """The same graph with its edges written as a table, for analytics that read them more than once."""
        from plexspark.plans.lineage import cut

        return Graph(self.vertices, cut(self.edges), self.directed)

    def dealt(self, *columns: str, both: bool = False):
        """A context with the edges ready for loops (``operators.edge_map.dealt``)."""
        from plexspark.operators.edge_map import dealt

        return dealt(self.edges.select(*columns), both)

    def stored(self, name: str, buckets: int | None = None, path: str | None = None) -> Graph:
        """The same graph from bucketed tables of the catalog (``sources.stored``): its loops start without moving edges."""
        from plexspark.sources import stored

        return stored.save(self, name, buckets, path)

    def symmetrized(self) -> Graph:
        return Graph(self.vertices, rules.symmetrize(self.edges), False)

    def with_edges(self, more: DataFrame, drop_self_loops: bool = True) -> Graph:
        """The graph with a batch of edges; an edge that is there already takes the batch's weight."""
        new = rules.typed(more)
        if drop_self_loops:
            new = rules.without_loops(new)
        new = rules.deduplicate(new, "max") if self.directed else rules.symmetrize(new)
        if self.weighted:
            both = self.edges.withColumn("_new", F.lit(0)).unionByName(new.select("src", "dst", "weight").withColumn("_new", F.lit(1)))
            own = both.groupBy("src", "dst").agg(F.max_by("weight", "_new").alias("weight"))
        else:
            own = self.edges.unionByName(new.select("src", "dst")).distinct()
        ends = new.select(F.explode(F.array("src", "dst")).alias("id"))
        return Graph(self.vertices.union(ends).distinct(), own, self.directed)

    def has_edges(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (src, dst) with a column present."""
        there = self.edges.select("src", "dst").withColumn("_there", F.lit(True))
        return pairs.join(there, ["src", "dst"], "left").withColumn("present", F.coalesce("_there", F.lit(False))).drop("_there")

    def neighbors(self, vertex: int, inward: bool = False) -> DataFrame:
        a, b = ("dst", "src") if inward else ("src", "dst")
        return self.edges.where(F.col(a) == vertex).select(F.col(b).alias("id"), *(["weight"] if self.weighted else []))

    def neighbors_of(self, vertices: DataFrame, inward: bool = False) -> DataFrame:
        """(id, neighbor[, weight]) for every vertex of a set (id)."""
        a, b = ("dst", "src") if inward else ("src", "dst")
        asked = vertices.select(F.col("id").alias(a)).distinct()
        return self.edges.join(asked, a, "left_semi").select(F.col(a).alias("id"), F.col(b).alias("neighbor"), *(["weight"] if self.weighted else []))

    def adjacency(self) -> DataFrame:
        """(id, neighbors): sorted arrays; a vertex's array is one value, so hubs make large rows."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("neighbors"))

    # Analytics; each has its module in plans.

    def bfs(self, source: int) -> DataFrame:
        from plexspark.plans import bfs

        return bfs.depths(self, source)

    def bfs_sources(self, sources: DataFrame) -> DataFrame:
        from plexspark.plans import bfs

        return bfs.search(self, sources)

    def bfs_parents(self, source: int) -> DataFrame:
        from plexspark.plans import bfs

        return bfs.parents(self, source)

    def betweenness(self, source: int, transpose_backward: bool = False) -> DataFrame:
        from plexspark.plans import betweenness

        return betweenness.dependencies(self, source, transpose_backward)

    def betweenness_sources(self, sources: DataFrame, transpose_backward: bool = False) -> DataFrame:
        from plexspark.plans import betweenness

        return betweenness.of_sources(self, sources, transpose_backward)

    def k_core(self, k: int) -> DataFrame:
        from plexspark.plans import cores

        return cores.core(self, k)

    def pagerank(self, rounds: int = 10, divisor: str | None = None) -> DataFrame:
        from plexspark.plans import pagerank

        return pagerank.ranks(self, rounds, divisor)

    def connected_components(self, weak: bool = False) -> DataFrame:
        from plexspark.plans import connected

        return connected.labels(self, weak)

    def triangle_count(self) -> DataFrame:
        from plexspark.plans import triangles

        return triangles.count(self)

    def triangles_per_vertex(self) -> DataFrame:
        from plexspark.plans import triangles

        return triangles.per_vertex(self)

    def common_neighbors(self, pairs: DataFrame) -> DataFrame:
        from plexspark.plans import triangles

        return triangles.common_neighbors(self, pairs)

    def shortest_paths(self, source: int) -> DataFrame:
        from plexspark.plans import shortest

        return shortest.distances(self, source)

    def gee(self, labels: DataFrame, k: int) -> DataFrame:
        from plexspark.plans import embedding

        return embedding.unweighted(self, labels, k)

    def gee_weighted(self, labels: DataFrame, k: int, laplacian: bool = False) -> DataFrame:
        from plexspark.plans import embedding

        return embedding.weighted(self, labels, k, laplacian)

    def degrees(self, inward: bool = False) -> DataFrame:
        from plexspark.plans import totals

        return totals.degrees(self, inward)

    def weighted_degrees(self) -> DataFrame:
        from plexspark.plans import totals

        return totals.weighted_degrees(self)

    def touch_all(self) -> DataFrame:
        from plexspark.plans import totals

        return totals.touch_all(self)

    def edge_checksum(self, order: DataFrame) -> DataFrame:
        from plexspark.plans import totals

        return totals.edge_checksum(self, order)
