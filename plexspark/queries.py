"""A query for every graph operator, over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from contextlib import redirect_stdout
from io import StringIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexspark import cli
from plexspark import fixtures as x
from plexspark.functions import edges as rules
from plexspark.graph import Graph
from plexspark.operators import edge_map as ops
from plexspark.operators import frontier
from plexspark.plans.lineage import cut, drop, place
from plexspark.sources import adj, generators
from plexspark.streaming import ingest

SQL: dict[str, str] = {}
QUERIES = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


# Views that the SQL builds on: edge lists as CTEs.
PAIR = """pair AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, min(CAST(trunc(abs(a.l_quantity - b.l_quantity)) AS INT) + 1) AS weight
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY 1, 2)"""
STEP = """step AS (
  SELECT a.o_custkey AS src, b.o_custkey AS dst, CAST(floor(a.o_totalprice / 1000) AS INT) AS weight
  FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1),
dir AS (SELECT src, dst, max(weight) AS weight FROM step WHERE src <> dst GROUP BY 1, 2)"""
BIP = """bip AS (
  SELECT DISTINCT l_partkey AS src, (SELECT count(*) FROM part) + l_suppkey AS dst FROM lineitem
  UNION SELECT (SELECT count(*) FROM part) + l_suppkey, l_partkey FROM lineitem)"""
LABEL = "label AS (SELECT p_partkey AS id, CASE WHEN p_size > 40 THEN -1 ELSE p_size % 5 END AS label FROM part)"
SIZES = "size AS (SELECT label, count(*) AS n FROM label WHERE label >= 0 GROUP BY 1)"


def _depth_sql(edges: str, name: str, ids: str) -> str:
    return f"""WITH RECURSIVE {edges}, walk(v, d) USING KEY (v) AS (
  SELECT CAST(0 AS BIGINT), 0 UNION
  SELECT e.dst, min(w.d + 1) FROM walk w JOIN {name} e ON e.src = w.v LEFT JOIN recurring.walk r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst)
SELECT i.id, coalesce(w.d, -1) AS depth FROM ({ids}) i LEFT JOIN walk w ON w.v = i.id"""


PARTS, CUSTOMERS = "SELECT p_partkey AS id FROM part", "SELECT c_custkey AS id FROM customer"


@query(_depth_sql(PAIR, "pair", PARTS))
def bfs_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).bfs(0)


@query(f"""WITH RECURSIVE {PAIR}, walk(v, d) USING KEY (v) AS (
  SELECT CAST(0 AS BIGINT), 0 UNION
  SELECT e.dst, min(w.d + 1) FROM walk w JOIN pair e ON e.src = w.v LEFT JOIN recurring.walk r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst),
up AS (SELECT b.v, min(a.v) AS p FROM walk b JOIN pair e ON e.dst = b.v JOIN walk a ON a.v = e.src AND a.d = b.d - 1 GROUP BY b.v)
SELECT i.id, CASE WHEN i.id = 0 THEN 0 ELSE coalesce(u.p, -1) END AS parent FROM ({PARTS}) i LEFT JOIN up u ON u.v = i.id""")
def bfs_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).bfs_parents(0)


@query(_depth_sql(STEP, "dir", CUSTOMERS))
def bfs_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir).bfs(0)


@query(f"""WITH RECURSIVE {PAIR}, walk(v, d, s) USING KEY (v) AS (
  SELECT CAST(0 AS BIGINT), 0, CAST(1 AS DOUBLE) UNION
  SELECT e.dst, min(w.d + 1), sum(w.s) FROM walk w JOIN pair e ON e.src = w.v LEFT JOIN recurring.walk r ON r.v = e.dst WHERE r.v IS NULL GROUP BY e.dst),
deepest AS (SELECT max(d) AS d FROM walk),
back(v, d, s, delta) AS (
  SELECT v, w.d, s, CAST(0 AS DOUBLE) FROM walk w, deepest t WHERE w.d = t.d
  UNION ALL
  SELECT w.v, any_value(w.d), any_value(w.s), coalesce(sum(CASE WHEN b.v IS NULL THEN 0 ELSE w.s / b.s * (1 + b.delta) END), 0)
  FROM (SELECT DISTINCT d FROM back) t JOIN walk w ON w.d = t.d - 1 LEFT JOIN (pair e JOIN back b ON b.v = e.dst) ON e.src = w.v GROUP BY w.v)
SELECT i.id, round(b.delta, 6) AS dependency, b.v IS NOT NULL AS reached FROM ({PARTS}) i LEFT JOIN back b ON b.v = i.id""")
def bc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = x.parts(spark, sf_dir).betweenness(0)
    known = ~F.isnan("dependency")
    return out.select("id", F.when(known, F.round("dependency", 6)).alias("dependency"), known.alias("reached"))


def _rank_sql(edges: str, name: str, divisor: str, ids: str, rounds: int = 10) -> str:
    return f"""WITH RECURSIVE {edges}, n AS (SELECT count(*) AS n FROM ({ids})),
deg AS (SELECT {divisor} AS id, count(*) AS d FROM {name} GROUP BY 1),
pr(it, id, p) AS (
  SELECT 0, i.id, CAST(1 AS DOUBLE) / n FROM ({ids}) i, n
  UNION ALL
  SELECT it + 1, e.dst, sum(p / d) FROM pr JOIN {name} e ON e.src = pr.id JOIN deg ON deg.id = e.src WHERE it < {rounds} GROUP BY it, e.dst)
SELECT i.id, round(coalesce(p, 0), 9) AS rank FROM ({ids}) i LEFT JOIN pr ON pr.id = i.id AND it = {rounds}"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("rank", 9).alias("rank"))


@query(_rank_sql(PAIR, "pair", "dst", PARTS))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(x.parts(spark, sf_dir).settled().pagerank(10))


@query(_rank_sql(STEP, "dir", "dst", CUSTOMERS))
def pagerank_directed_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(x.customers(spark, sf_dir).pagerank(10, divisor="in"))


@query(_rank_sql(STEP, "dir", "src", CUSTOMERS))
def pagerank_directed_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(x.customers(spark, sf_dir).pagerank(10))


def _label_sql(edges: str, name: str, ids: str) -> str:
    return f"""WITH RECURSIVE {edges}, cc(v, c) USING KEY (v) AS (
  SELECT id, id FROM ({ids}) UNION
  SELECT e.dst, min(cc.c) FROM cc JOIN {name} e ON e.src = cc.v JOIN recurring.cc r ON r.v = e.dst WHERE cc.c < r.c GROUP BY e.dst)
SELECT v AS id, c AS component FROM cc"""


@query(_label_sql(PAIR, "pair", PARTS))
def cc_min_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).connected_components()


@query("""SELECT id, min(id) OVER (PARTITION BY c) AS component FROM (
  SELECT c_custkey AS id, c_custkey AS c FROM customer UNION ALL SELECT (SELECT count(*) FROM customer) + o_orderkey, o_custkey FROM orders)""")
def cc_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.orders(spark, sf_dir).connected_components()


@query(_label_sql(STEP, "dir", CUSTOMERS))
def cc_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir).connected_components()


TRIANGLES = "SELECT count(*) AS triangles FROM {e} a JOIN {e} b ON b.src = a.dst JOIN {e} c ON c.src = a.src AND c.dst = b.dst WHERE a.src < a.dst AND b.src < b.dst"


@query(f"WITH {PAIR} " + TRIANGLES.format(e="pair"))
def tc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).triangle_count()


@query(f"WITH {BIP} " + TRIANGLES.format(e="bip"))
def tc_bipartite_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.suppliers(spark, sf_dir).triangle_count()


@query(f"""WITH RECURSIVE {PAIR}, bf(v, d) USING KEY (v) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT e.dst, min(bf.d + e.weight) FROM bf JOIN pair e ON e.src = bf.v LEFT JOIN recurring.bf r ON r.v = e.dst WHERE r.v IS NULL OR bf.d + e.weight < r.d GROUP BY e.dst)
SELECT i.id, CAST(coalesce(bf.d, 1073741823) AS INT) AS dist FROM ({PARTS}) i LEFT JOIN bf ON bf.v = i.id""")
def bellman_ford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir, weighted=True).shortest_paths(0)


@query(f"""WITH RECURSIVE {STEP}, bf(v, d) USING KEY (v) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION
  SELECT e.dst, min(bf.d + e.weight) FROM bf JOIN dir e ON e.src = bf.v LEFT JOIN recurring.bf r ON r.v = e.dst WHERE r.v IS NULL OR bf.d + e.weight < r.d GROUP BY e.dst)
SELECT i.id, CAST(coalesce(bf.d, 1073741823) AS INT) AS dist FROM ({CUSTOMERS}) i LEFT JOIN bf ON bf.v = i.id""")
def bellman_ford_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir, weighted=True).shortest_paths(0)


@query("SELECT c_custkey AS id, -1073741823 AS dist FROM customer")
def bellman_ford_negative_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = x.customer_steps(spark, sf_dir).withColumn("weight", -F.col("weight") - 1)
    ids = x.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return Graph.from_edges(edges, ids, directed=True, drop_self_loops=True).shortest_paths(0)


def _cells(df: DataFrame) -> DataFrame:
    return df.select("id", "cluster", F.round("value", 9).alias("value"))


def _gee_sql(rows: str, edges: str = PAIR, label: str = LABEL, ids: str = PARTS, k: int = 5) -> str:
    """rows: SELECT of (id, other, w)."""
    return f"""WITH {edges}, {label}, {SIZES}, row AS ({rows}),
cell AS (SELECT r.id, l.label AS cluster, sum(r.w) / any_value(s.n) AS value FROM row r JOIN label l ON l.id = r.other JOIN size s ON s.label = l.label GROUP BY 1, 2)
SELECT i.id, CAST(k.k AS INT) AS cluster, round(coalesce(c.value, 0), 9) AS value FROM ({ids}) i CROSS JOIN range({k}) k(k) LEFT JOIN cell c ON c.id = i.id AND c.cluster = k.k"""


@query(_gee_sql("SELECT dst AS id, src AS other, CAST(2 AS DOUBLE) AS w FROM pair"))
def gee(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(x.parts(spark, sf_dir).gee(x.part_labels(spark, sf_dir), 5))


NATION = "label AS (SELECT c_custkey AS id, c_nationkey AS label FROM customer)"


@query(_gee_sql("SELECT dst AS id, src AS other, CAST(1 AS DOUBLE) AS w FROM dir UNION ALL SELECT src, dst, 1 FROM dir", STEP, NATION, CUSTOMERS, 25))
def gee_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(x.customers(spark, sf_dir).gee(x.customer_labels(spark, sf_dir), 25))


@query(_gee_sql("SELECT dst AS id, src AS other, CAST(2 * weight AS DOUBLE) AS w FROM pair"))
def gee_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(x.parts(spark, sf_dir, weighted=True).gee_weighted(x.part_labels(spark, sf_dir), 5))


@query(_gee_sql("SELECT e.dst AS id, e.src AS other, e.weight / sqrt(CAST(a.d AS DOUBLE) * b.d) AS w FROM pair e JOIN deg a ON a.id = e.src JOIN deg b ON b.id = e.dst", PAIR + ", deg AS (SELECT src AS id, sum(weight) AS d FROM pair GROUP BY 1)"))
def gee_laplacian(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(x.parts(spark, sf_dir, weighted=True).settled().gee_weighted(x.part_labels(spark, sf_dir), 5, laplacian=True))


@query(f"WITH {PAIR} SELECT i.id, count(e.src) AS degree FROM ({PARTS}) i LEFT JOIN pair e ON e.dst = i.id GROUP BY 1")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).degrees(inward=True)


@query(f"WITH {PAIR} SELECT i.id, CAST(coalesce(sum(2 * e.weight), 0) AS BIGINT) AS degree FROM ({PARTS}) i LEFT JOIN pair e ON e.src = i.id GROUP BY 1")
def weighted_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir, weighted=True).weighted_degrees()


@query(f"WITH {PAIR} SELECT CAST(sum(src) AS BIGINT) AS total FROM pair")
def touch_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).touch_all()


@query(f"WITH {PAIR} SELECT CAST(sum(e.dst) AS BIGINT) AS total FROM lineitem l JOIN pair e ON e.src = l.l_partkey")
def edge_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).edge_checksum(x.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")))


@query(f"""WITH {PAIR} SELECT p.src AS a, p.dst AS b, count(q.dst) AS common
FROM pair p LEFT JOIN (pair e JOIN pair q ON q.dst = e.dst) ON e.src = p.src AND q.src = p.dst AND e.dst < least(p.src, p.dst) WHERE p.src < p.dst GROUP BY 1, 2""")
def common_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = x.parts(spark, sf_dir).settled()
    return g.common_neighbors(g.edges.where("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")))


@query(f"WITH {STEP} SELECT src, dst FROM dir UNION SELECT dst, src FROM dir")
def symmetrize_unweighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir, directed=False).edges


@query(f"WITH {STEP} SELECT src, dst, min(weight) AS weight FROM (SELECT * FROM step UNION ALL SELECT dst, src, weight FROM step) WHERE src <> dst GROUP BY 1, 2")
def symmetrize_min_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir, directed=False, weighted=True).edges


@query(f"WITH {STEP} SELECT src, dst, max(weight) AS weight FROM step GROUP BY 1, 2")
def directed_max_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir, weighted=True, drop_self_loops=False).edges


@query(f"WITH {STEP} SELECT DISTINCT src, dst FROM step WHERE src <> dst")
def drop_self_loops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.deduplicate(rules.without_loops(rules.typed(x.customer_steps(spark, sf_dir).select("src", "dst"))))


RICH = "SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000"


@query(f"WITH {STEP} SELECT dst AS id, min(src) AS value FROM dir WHERE src IN ({RICH}) AND dst NOT IN ({RICH}) GROUP BY 1")
def edge_map_one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = x.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return ops.edge_map(x.customers(spark, sf_dir).edges, rich, F.col("src"), F.min, cond=rich)


@query(f"WITH {STEP} SELECT src AS id, CAST(sum(weight) AS BIGINT) AS value FROM dir GROUP BY 1")
def edge_map_inward_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = x.customers(spark, sf_dir, weighted=True)
    return ops.edge_map(g.edges, None, F.col("weight").cast("long"), F.sum, inward=True)


@query("SELECT c_custkey AS id, 2 * c_nationkey AS twice FROM customer WHERE c_nationkey % 2 = 1")
def vertex_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = x.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return ops.vertex_map(ids, {"twice": 2 * F.col("c_nationkey")}, F.col("c_nationkey") % 2 == 1).drop("c_nationkey")


@query(f"WITH {STEP} SELECT count(*) AS total FROM dir WHERE src IN ({RICH})")
def subset_out_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = x.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))
    return frontier.out_degree(rich, x.customers(spark, sf_dir).edges)


@query(f"WITH {STEP} SELECT DISTINCT a.dst AS src, a.src AS dst, EXISTS (SELECT 1 FROM dir b WHERE b.src = a.dst AND b.dst = a.src) AS present FROM dir a")
def has_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = x.customers(spark, sf_dir)
    return g.has_edges(rules.reverse(g.edges))


@query(f"""WITH {STEP}, sym AS (SELECT src, dst, min(weight) AS weight FROM (SELECT * FROM dir UNION ALL SELECT dst, src, weight FROM dir) GROUP BY 1, 2),
new AS (SELECT o_custkey AS src, (o_custkey + o_orderkey) % (SELECT count(*) FROM customer) AS dst, 7 AS weight FROM orders),
sn AS (SELECT DISTINCT src, dst, weight FROM (SELECT * FROM new UNION ALL SELECT dst, src, weight FROM new) WHERE src <> dst)
SELECT src, dst, coalesce(b.weight, a.weight) AS weight FROM sym a FULL JOIN sn b USING (src, dst)""")
def batch_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = x.customers(spark, sf_dir, weighted=True).symmetrized()
    n = g.num_nodes()
    more = x.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("src"), ((F.col("o_custkey") + F.col("o_orderkey")) % n).alias("dst"), F.lit(7).alias("weight"))
    return g.with_edges(more).edges


@query(f"WITH {PAIR} SELECT i.id, CAST(coalesce(sum(count(e.src)) OVER (ORDER BY i.id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM ({PARTS}) i LEFT JOIN pair e ON e.src = i.id GROUP BY i.id")
def adj_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adj.adj_offsets(x.parts(spark, sf_dir))


@query(f"WITH {PAIR} SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ',' ORDER BY dst) AS neighbors FROM pair GROUP BY 1")
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).adjacency().select("id", F.array_join(F.col("neighbors").cast("array<string>"), ",").alias("neighbors"))


# Files: what is written is read again.


def _round_trip(g: Graph, **how) -> Graph:
    path, own = place(g.spark), g.settled()
    adj.write_adj(own, path)
    drop(own.edges)
    return adj.read_adj(g.spark, path, **how)


@query(f"WITH {PAIR} SELECT src, dst FROM pair")
def adj_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(x.parts(spark, sf_dir)).edges


@query(f"WITH {STEP} SELECT src, dst, weight FROM dir")
def adj_weighted_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(x.customers(spark, sf_dir, weighted=True), symmetric=False).edges


@query(f"WITH {STEP} SELECT src, dst FROM dir UNION SELECT dst, src FROM dir")
def adj_symmetrized_without_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(x.customers(spark, sf_dir, weighted=True), weighted=False, symmetric=True).edges


@query(f"WITH {STEP} SELECT src, dst, 1 AS weight FROM dir")
def adj_given_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(x.customers(spark, sf_dir), weighted=True, symmetric=False).edges


# A sound file's words (place, word) with one fault each: what becomes of a word, which words stay, and how many more there are.
FAULTS = {
    "sound": ("word", "TRUE", 0),
    "header": ("if(place = 0, 'Graph', word)", "TRUE", 0),
    "vertices": ("if(place = 1, '0', word)", "TRUE", 0),
    "edges": ("if(place = 2, '0', word)", "TRUE", 0),
    "short": ("word", "place < 2 + n + m", -1),
    "long": ("if(place = 2 + n + m, word || ' 7', word)", "TRUE", 1),
    "weights": (f"if(place = 0, '{adj.WEIGHTED}', word)", "TRUE", 0),
    "number": ("if(place = 3 + n, 'x', word)", "TRUE", 0),
    "end": ("if(place = 3 + n, cast(n AS string), word)", "TRUE", 0),
    "offsets": ("if(place = 3, cast(m AS string), word)", "TRUE", 0),
}


@query(f"WITH {STEP}, size AS (SELECT 3 + (SELECT count(*) FROM customer) + (SELECT count(*) FROM dir) AS w) SELECT kind, w + more AS words, kind <> 'sound' AS rejected FROM size, (VALUES " + ", ".join(f"('{c}', {more})" for c, (_, _, more) in FAULTS.items()) + ") v(kind, more)")
def adj_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph's file, and what it is with one fault."""
    path, out = place(spark), []
    g = x.customers(spark, sf_dir).settled()
    adj.write_adj(g, path)
    sound = cut(adj.words(spark, path).withColumns({"n": F.lit(g.num_nodes()), "m": F.lit(g.num_edges())}))
    for kind, (word, stays, _) in FAULTS.items():
        path, rejected = place(spark), False
        sound.where(stays).select("place", F.expr(word).alias("word")).repartitionByRange("place").sortWithinPartitions("place").select("word").write.text(path)
        try:
            adj.read_adj(spark, path, symmetric=False)
        except ValueError:
            rejected = True
        out.append((kind, adj.words(spark, path).count(), rejected))
    return spark.createDataFrame(out, "kind string, words long, rejected boolean")


@query(f"WITH {STEP} SELECT src, dst FROM dir")
def adj_mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file with offsets a line each and all ends on one line, read in ranges of a few bytes."""
    whole, mixed = place(spark), place(spark)
    g = x.customers(spark, sf_dir).settled()
    adj.write_adj(g, whole)
    first = 3 + g.num_nodes()
    words = adj.words(spark, whole).select("place", F.concat("word", F.when(F.col("place") < first, "\n").otherwise(" ")).alias("word"))
    words.repartitionByRange("place").sortWithinPartitions("place").select("word").write.option("lineSep", "\t").text(mixed)
    return adj.graph_of(spark, mixed, adj.words(spark, mixed, size=1 << 12), symmetric=False).edges


@query("SELECT c_custkey AS id, c_nationkey AS label FROM customer")
def labels_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    adj.write_values(x.customer_labels(spark, sf_dir), path)
    return adj.read_labels(spark, path)


@query("SELECT c_custkey AS id, format('{:g}', c_acctbal) AS line FROM customer")
def value_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    adj.write_values(x.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), path)
    return adj.lines(spark, path)


@query(_gee_sql("SELECT dst AS id, src AS other, CAST(1 AS DOUBLE) AS w FROM dir UNION ALL SELECT src, dst, 1 FROM dir", STEP, NATION, CUSTOMERS, 25).replace("SELECT i.id, CAST(k.k AS INT) AS cluster, round(coalesce(c.value, 0), 9) AS value", "SELECT i.id, string_agg(printf('%.6f', coalesce(c.value, 0)), ' ' ORDER BY k.k) AS line") + " GROUP BY i.id")
def embedding_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    adj.write_embedding(x.customers(spark, sf_dir).gee(x.customer_labels(spark, sf_dir), 25), path)
    return adj.lines(spark, path)


@query(_depth_sql(STEP, "dir", CUSTOMERS).replace("coalesce(w.d, -1) AS depth", "CAST(coalesce(w.d, -1) AS VARCHAR) AS line"))
def command_line_bfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, out = place(spark), place(spark)
    adj.write_adj(x.customers(spark, sf_dir).settled(), path)
    with redirect_stdout(StringIO()):
        cli.main(["-g", path, "--algorithm", "bfs", "--src", "0", "--iters", "1", "--symmetric", "false", "--output", out], spark)
    return adj.lines(spark, f"{out}/bfs.out")


# Lookups and vertex sets.


def _rich(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("id"))


@query(f"WITH {STEP} SELECT src AS id, dst AS neighbor, weight FROM dir WHERE src IN ({RICH})")
def neighbors_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir, weighted=True).neighbors_of(_rich(spark, sf_dir))


@query(f"WITH {STEP} SELECT dst AS id, src AS neighbor, weight FROM dir WHERE dst IN ({RICH})")
def neighbors_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir, weighted=True).neighbors_of(_rich(spark, sf_dir), inward=True)


@query("SELECT c_custkey AS id FROM customer WHERE c_acctbal > 5000 OR c_nationkey = 7 OR c_custkey IN (0, 3)")
def frontier_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = x.table(spark, sf_dir, "customer").where("c_nationkey = 7").select(F.col("c_custkey").alias("id"))
    return frontier.insert(frontier.insert(frontier.insert(_rich(spark, sf_dir), more), frontier.single(spark, 0)), frontier.of(spark, [0, 3]))


@query("SELECT DISTINCT o_custkey AS id FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def frontier_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frontier.members(_rich(spark, sf_dir), x.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).distinct())


@query("SELECT count(*) FILTER (WHERE c_acctbal > 5000) AS size, count(*) FILTER (WHERE c_acctbal > 5000) > 0 AS non_empty, count(*) FILTER (WHERE c_acctbal > 1e12) > 0 AS none_left FROM customer")
def frontier_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    rich = _rich(spark, sf_dir)
    none = x.table(spark, sf_dir, "customer").where("c_acctbal > 1e12").select(F.col("c_custkey").alias("id"))
    return spark.createDataFrame([(frontier.size(rich), frontier.non_empty(rich), frontier.non_empty(none))], "size long, non_empty boolean, none_left boolean")


# Generators: partners are drawn by a hash that the SQL has too.


def _drawn_sql(first: str, each: int, seed: int) -> str:
    return f"""WITH n AS (SELECT count(*) AS n FROM part),
one AS (SELECT s.s AS src, CAST('0x' || substr(md5(s.s || '/' || i.i || '/{seed}'), 1, 15) AS BIGINT) % n AS dst FROM n, range({first}) s(s), range(1, {each + 1}) i(i))
SELECT src, dst FROM one WHERE src <> dst UNION SELECT dst, src FROM one WHERE src <> dst"""


@query(_drawn_sql("(SELECT n FROM n)", 4, 1))
def generator_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.uniform(spark, x.table(spark, sf_dir, "part").count(), per_node=8, seed=1).edges


@query(_drawn_sql("10", 500, 2))
def generator_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.skewed(spark, x.table(spark, sf_dir, "part").count(), hubs=10, degree=500, seed=2).edges


# Directed and weak forms.


@query(SQL["bc"].replace(PAIR, STEP).replace("JOIN pair e", "JOIN dir e").replace("(pair e", "(dir e").replace(PARTS, CUSTOMERS))
def bc_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = x.customers(spark, sf_dir).betweenness(0, transpose_backward=True)
    known = ~F.isnan("dependency")
    return out.select("id", F.when(known, F.round("dependency", 6)).alias("dependency"), known.alias("reached"))


@query(_label_sql(STEP + ", link AS (SELECT src, dst FROM dir UNION SELECT dst, src FROM dir)", "link", CUSTOMERS))
def cc_weak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir).connected_components(weak=True)


@query(_gee_sql("SELECT dst AS id, src AS other, CAST(weight AS DOUBLE) AS w FROM dir UNION ALL SELECT src, dst, weight FROM dir", STEP, NATION, CUSTOMERS, 25))
def gee_weighted_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(x.customers(spark, sf_dir, weighted=True).gee_weighted(x.customer_labels(spark, sf_dir), 25))


# Several sources in the same rounds, cores, corners of triangles, and a combine in Python.


def _few(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return x.table(spark, sf_dir, name).where(F.col(key).between(1, 5)).select(F.col(key).alias("source"))


@query(f"""WITH RECURSIVE {PAIR}, walk(s, v, d) USING KEY (s, v) AS (
  SELECT p_partkey, p_partkey, 0 FROM part WHERE p_partkey BETWEEN 1 AND 5 UNION
  SELECT w.s, e.dst, min(w.d + 1) FROM walk w JOIN pair e ON e.src = w.v LEFT JOIN recurring.walk r ON r.s = w.s AND r.v = e.dst WHERE r.v IS NULL GROUP BY w.s, e.dst)
SELECT s AS source, v AS id, d AS depth FROM walk""")
def bfs_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).bfs_sources(_few(spark, sf_dir, "part", "p_partkey")).select("source", "id", "depth")


@query(f"""WITH RECURSIVE {STEP}, walk(o, v, d, s) USING KEY (o, v) AS (
  SELECT c_custkey, c_custkey, 0, CAST(1 AS DOUBLE) FROM customer WHERE c_custkey BETWEEN 1 AND 5 UNION
  SELECT w.o, e.dst, min(w.d + 1), sum(w.s) FROM walk w JOIN dir e ON e.src = w.v LEFT JOIN recurring.walk r ON r.o = w.o AND r.v = e.dst WHERE r.v IS NULL GROUP BY w.o, e.dst),
deepest AS (SELECT o, max(d) AS d FROM walk GROUP BY o),
back(o, v, d, s, delta) AS (
  SELECT w.o, v, w.d, s, CAST(0 AS DOUBLE) FROM walk w JOIN deepest t ON t.o = w.o AND t.d = w.d
  UNION ALL
  SELECT w.o, w.v, any_value(w.d), any_value(w.s), coalesce(sum(CASE WHEN b.v IS NULL THEN 0 ELSE w.s / b.s * (1 + b.delta) END), 0)
  FROM (SELECT DISTINCT o, d FROM back) t JOIN walk w ON w.o = t.o AND w.d = t.d - 1 LEFT JOIN (dir e JOIN back b ON b.v = e.dst) ON e.src = w.v AND b.o = w.o GROUP BY w.o, w.v)
SELECT o AS source, v AS id, round(delta, 6) AS dependency FROM back""")
def bc_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = x.customers(spark, sf_dir).betweenness_sources(_few(spark, sf_dir, "customer", "c_custkey"), transpose_backward=True)
    return found.select("source", "id", F.round("dependency", 6).alias("dependency"))


CORE = 13


@query(f"""WITH RECURSIVE {STEP}, link AS (SELECT src, dst FROM dir UNION SELECT dst, src FROM dir), deg AS (SELECT src AS v, count(*) AS d FROM link GROUP BY 1),
gone(v, n) USING KEY (v) AS (
  SELECT v, 1 FROM deg WHERE d < {CORE} UNION
  SELECT n.v, 1 FROM (SELECT DISTINCT l.dst AS v FROM gone g JOIN link l ON l.src = g.v) n JOIN deg ON deg.v = n.v JOIN link l ON l.src = n.v
  JOIN recurring.gone q ON q.v = l.dst LEFT JOIN recurring.gone r ON r.v = n.v WHERE r.v IS NULL GROUP BY n.v, deg.d HAVING deg.d - count(*) < {CORE})
SELECT src AS id, count(*) AS degree FROM link WHERE src NOT IN (SELECT v FROM gone) AND dst NOT IN (SELECT v FROM gone) GROUP BY 1""")
def k_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.customers(spark, sf_dir).k_core(CORE)


@query(f"""WITH {PAIR}, deg AS (SELECT src AS id, count(*) AS d FROM pair GROUP BY 1),
corner AS (SELECT a.src AS id, count(*) // 2 AS n FROM pair a JOIN pair b ON b.src = a.dst JOIN pair c ON c.src = a.src AND c.dst = b.dst GROUP BY 1)
SELECT i.id, coalesce(n, 0) AS triangles, round(CASE WHEN d > 1 THEN CAST(2 * coalesce(n, 0) AS DOUBLE) / (d * (d - 1)) ELSE 0 END, 9) AS clustering
FROM ({PARTS}) i LEFT JOIN deg USING (id) LEFT JOIN corner USING (id)""")
def triangles_per_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x.parts(spark, sf_dir).triangles_per_vertex().select("id", "triangles", F.round("clustering", 9).alias("clustering"))


@query(f"WITH {STEP} SELECT dst AS id, list_reduce(list_prepend(0, list_sort(list(src))), lambda a, x: (31 * a + x) % 1000003) AS value FROM dir GROUP BY 1")
def edge_map_python_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def folded(senders: pd.Series) -> int:
        out = 0
        for s in sorted(senders):
            out = (31 * out + s) % 1000003
        return out

    return ops.edge_map(x.customers(spark, sf_dir).edges, None, F.col("src"), folded)


# All files that the command line writes.

SYM = STEP + ", sym AS (SELECT src, dst, min(weight) AS weight FROM (SELECT src, dst, weight FROM dir UNION ALL SELECT dst, src, weight FROM dir) GROUP BY 1, 2)"


def _file(name: str, line: str, sql: str) -> str:
    return f"SELECT '{name}' AS file, id, {line} AS line FROM ({sql})"


def _wide(rows: str) -> str:
    cells = _gee_sql(rows, SYM, NATION, CUSTOMERS, 25).replace("round(coalesce(c.value, 0), 9)", "coalesce(c.value, 0)")
    return f"SELECT id, string_agg(printf('%.6f', value), ' ' ORDER BY cluster) AS line FROM ({cells}) GROUP BY id"


_BC = SQL["bc"].replace("round(b.delta, 6)", "b.delta").replace(PAIR, SYM).replace("JOIN pair e", "JOIN sym e").replace("(pair e", "(sym e").replace(PARTS, CUSTOMERS)
_BF = SQL["bellman_ford"].replace(PAIR, SYM).replace("JOIN pair e", "JOIN sym e").replace(PARTS, CUSTOMERS)
FILES = {
    "bfs": ("bfs.out", False, "CAST(depth AS VARCHAR)", _depth_sql(SYM, "sym", CUSTOMERS)),
    "bc": ("bc.out", False, "CASE WHEN reached THEN format('{:g}', dependency) ELSE 'nan' END", _BC),
    "pr": ("pr.out", False, "format('{:g}', rank)", _rank_sql(SYM, "sym", "dst", CUSTOMERS).replace("round(coalesce(p, 0), 9)", "coalesce(p, 0)")),
    "cc": ("cc.out", False, "CAST(component AS VARCHAR)", _label_sql(SYM, "sym", CUSTOMERS)),
    "gee": ("gee.out", False, "line", _wide("SELECT dst AS id, src AS other, CAST(2 AS DOUBLE) AS w FROM sym")),
    "bf": ("bf.out", True, "CAST(dist AS VARCHAR)", _BF),
    "gee weighted": ("gee_weighted.out", True, "line", _wide("SELECT dst AS id, src AS other, CAST(2 * weight AS DOUBLE) AS w FROM sym")),
}


@query(" UNION ALL ".join(_file(name, line, sql) for name, _, line, sql in FILES.values()))
def command_line_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every analytic from one adjacency file, each run writing the file of its name."""
    path, labels, out = place(spark), place(spark), place(spark)
    adj.write_adj(x.customers(spark, sf_dir, weighted=True).settled(), path)
    adj.write_values(x.customer_labels(spark, sf_dir), labels)
    found = None
    for algorithm, (name, weighted, *_) in FILES.items():
        with redirect_stdout(StringIO()):
            how = ["-w"] if weighted else []
            cli.main(["-g", path, "--algorithm", algorithm.split()[0], "--src", "0", "--iters", "1", "--nClusters", "25", "--y_location", labels, "--output", out, *how], spark)
        lines = adj.lines(spark, f"{out}/{name}").withColumn("file", F.lit(name))
        found = lines if found is None else found.union(lines)
    return found


# A graph stored in buckets, and the stress graph on a small scale.


@query(_rank_sql(PAIR, "pair", "dst", PARTS, rounds=3))
def pagerank_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"parts_{uuid.uuid4().hex}"
    return _ranked(x.parts(spark, sf_dir).stored(name, path=place(spark)).pagerank(3))


# Edges that arrive as a stream, in batches of a file.


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, steps = place(spark), x.customer_steps(spark, sf_dir).select("src", "dst")
    steps.repartition(3).write.parquet(path)
    return spark.readStream.schema(steps.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(f"WITH {STEP} SELECT src, dst FROM dir UNION SELECT dst, src FROM dir")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    ingest.ingest(_stream(spark, sf_dir), path, place(spark)).awaitTermination()
    return ingest.load(spark, path).edges


@query(f"WITH {STEP} SELECT src AS id, count(*) AS edges FROM step GROUP BY 1")
def stream_degree_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark)
    counts = ingest.degree_counts(_stream(spark, sf_dir)).writeStream.outputMode("complete").option("checkpointLocation", place(spark))
    counts.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


@query(f"WITH {STEP} SELECT src AS id, count(DISTINCT dst) AS degree FROM (SELECT src, dst FROM step UNION ALL SELECT src, dst FROM dir) GROUP BY 1")
def stream_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-degrees of a stream that sends many edges again in later batches."""
    sent, path = place(spark), place(spark)
    g = x.customers(spark, sf_dir)
    x.customer_steps(spark, sf_dir).select("src", "dst").repartition(3).write.parquet(sent)
    g.edges.repartition(2).write.mode("append").parquet(sent)
    stream = spark.readStream.schema(g.edges.schema).option("maxFilesPerTrigger", 1).parquet(sent)
    degrees = ingest.degrees(stream).writeStream.outputMode("complete").option("checkpointLocation", place(spark))
    degrees.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(path)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)
