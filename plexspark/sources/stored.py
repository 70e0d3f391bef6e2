"""Graphs stored ready for loops: edges bucketed and sorted by src, and a second copy by dst."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import ExitStack, contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexspark.graph import Graph
from plexspark.operators.edge_map import Dealt, hubs_of, parted
from plexspark.plans.lineage import held


class StoredGraph(Graph):
    """A graph whose loops find their edges where they belong: they start without an exchange of edges.

    Joins that start from ``edges`` use the buckets as well, as those of a table
    of Spark's catalog; buckets of a hub, with very many edges at one end, are
    told apart by a hash of the other end, as ``operators.edge_map.dealt`` does.
    """

    def __init__(self, vertices: DataFrame, out: DataFrame, into: DataFrame, hubs: dict[str, DataFrame | None], directed: bool):
        super().__init__(vertices, out.drop("part"), directed)
        self.layouts, self.hubs = {"src": out, "dst": into}, hubs

    @contextmanager
    def dealt(self, *columns: str, both: bool = False) -> Iterator[Dealt]:
        with ExitStack() as stack:
            found = {}
            for by in ("src", "dst") if both else ("src",):
                hubs = self.hubs[by]
                key = [by, "part"] if hubs is not None else [by]
                rows = self.layouts[by].select(*columns, *key[1:])
                found[by] = Dealt(stack.enter_context(held(rows.sortWithinPartitions(*key))), hubs, by)
            found["src"].back = found.get("dst")
            yield found["src"]


def _tables(name: str) -> dict[str, str]:
    return {"vertices": f"{name}_vertices", "src": f"{name}_out", "dst": f"{name}_in", "hubs_src": f"{name}_out_hubs", "hubs_dst": f"{name}_in_hubs"}


def save(g: Graph, name: str, buckets: int | None = None, path: str | None = None) -> StoredGraph:
    """Write a graph as tables of the catalog whose names begin with ``name``, in the warehouse or under ``path``; and open it."""
    spark, tables = g.spark, _tables(name)
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    where = lambda table: {"path": f"{path}/{table}"} if path else {}
    g.vertices.write.mode("overwrite").options(**where("vertices")).saveAsTable(tables["vertices"], format="parquet")
    own = g.settled()
    for by in ("src", "dst"):
        hubs, found = hubs_of(own.edges, by)
        hubs.write.mode("overwrite").options(**where(f"hubs_{by}")).saveAsTable(tables[f"hubs_{by}"], format="parquet")
        rows = parted(own.edges, hubs if found else None, by).repartition(buckets, by, "part") if found else own.edges.withColumn("part", F.lit(0)).repartition(buckets, by)
        key = [by, "part"] if found else [by]
        # one file a bucket: rows are dealt by the hash that buckets are
        rows.write.mode("overwrite").bucketBy(buckets, *key).sortBy(*key).options(**where(by)).saveAsTable(tables[by], format="parquet")
    spark.sql(f"ALTER TABLE {tables['vertices']} SET TBLPROPERTIES ('directed' = '{str(g.directed).lower()}')")
    return load(spark, name)


def load(spark: SparkSession, name: str) -> StoredGraph:
    tables = _tables(name)
    directed = spark.sql(f"SHOW TBLPROPERTIES {tables['vertices']} ('directed')").first()["value"] == "true"
    hubs = {by: t if not (t := spark.table(tables[f"hubs_{by}"])).isEmpty() else None for by in ("src", "dst")}
    return StoredGraph(spark.table(tables["vertices"]), spark.table(tables["src"]), spark.table(tables["dst"]), hubs, directed)
