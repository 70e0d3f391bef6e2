"""The fixpoint operator, what is built on it, and how edges are held for loops."""

import random
from collections import defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from plexspark.graph import Graph
from plexspark.operators import iterate as module
from plexspark.operators.edge_map import dealt, edge_map
from plexspark.operators.iterate import iterate
from plexspark.sources import generators


def graph(spark, edges, n, directed=False):
    return Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"), n, directed)


def drawn(n=40, m=90, seed=1):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def links(edges):
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    return near


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def test_own_algorithm_with_rounds_and_merges(spark, monkeypatch):
    """The greatest value within three steps, with changes merged after every round."""
    monkeypatch.setattr(module, "APART", 1)
    edges, n = drawn(), 40
    g = graph(spark, edges, n)
    state = g.vertices.select("id", ((F.col("id") * 17) % 41).alias("value"))
    got = values(iterate(g.edges, state, F.col("value"), F.max, update=lambda old, new: F.when(new > old, new), rounds=3))
    near, want = links(edges), {v: v * 17 % 41 for v in range(n)}
    for _ in range(3):
        want = {v: max([want[v], *(want[u] for u in near[v])]) for v in range(n)}
    assert got == want


def test_without_a_sender_or_state_nothing_happens(spark):
    g = graph(spark, [(0, 1), (1, 2)], 3)
    none = spark.createDataFrame([], "id long, value long")
    assert values(iterate(g.edges, none, F.col("value"), F.min)) == {}
    state = spark.createDataFrame([(0, 5)], "id long, value long")
    assert values(iterate(g.edges, state, F.col("value"), F.min, first=none)) == {0: 5}
    assert values(iterate(g.edges, state, F.col("value"), F.min)) == {0: 5, 1: 5, 2: 5}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    rounds = []
    observed = module.cut_observed
    monkeypatch.setattr(module, "cut_observed", lambda *a, **k: rounds.append(1) or observed(*a, **k))
    g = graph(spark, [(i, i + 1) for i in range(999)], 1000, directed=True)
    assert set(values(g.connected_components()).values()) == {0}
    assert len(rounds) <= 13


@pytest.mark.parametrize("directed", [False, True])
def test_several_sources_equal_one_by_one(spark, directed):
    g = graph(spark, drawn(seed=3), 40, directed)
    sources = spark.createDataFrame([(0,), (7,), (7,), (None,), (39,)], "source long")
    many = {(r.source, r.id): r.depth for r in g.bfs_sources(sources).collect()}
    shares = {(r.source, r.id): r.dependency for r in g.betweenness_sources(sources, transpose_backward=directed).collect()}
    assert {s for s, _ in many} == {0, 7, 39} and many.keys() == shares.keys()
    for s in (0, 7, 39):
        assert {v: d for v, d in values(g.bfs(s)).items() if d >= 0} == {v: d for (x, v), d in many.items() if x == s}
        for v, d in values(g.betweenness(s, transpose_backward=directed)).items():
            assert shares.get((s, v)) is None if d != d else shares[s, v] == pytest.approx(d)


@pytest.mark.parametrize("k", [3, 4])
def test_cores(spark, k):
    edges = drawn(30, 70, seed=5)
    near = links(edges)
    left = {v for v in range(30)}
    while gone := {v for v in left if len(near[v] & left) < k}:
        left -= gone
    assert values(graph(spark, edges, 30).k_core(k)) == {v: len(near[v] & left) for v in left}
    assert values(graph(spark, edges, 30, directed=True).k_core(k)) == {v: len(near[v] & left) for v in left}


def test_corners_of_triangles(spark):
    edges = drawn(25, 80, seed=6)
    near, want = links(edges), dict.fromkeys(range(25), 0)
    for a, b, c in combinations(range(25), 3):
        if b in near[a] and c in near[a] and c in near[b]:
            for v in (a, b, c):
                want[v] += 1
    g = graph(spark, edges, 25)
    got = {r.id: (r.triangles, r.clustering) for r in g.triangles_per_vertex().collect()}
    assert {v: t for v, (t, _) in got.items()} == want and sum(want.values()) == 3 * g.triangle_count().first()[0] > 0
    for v, (t, share) in got.items():
        d = len(near[v])
        assert share == pytest.approx(2 * t / (d * (d - 1)) if d > 1 else 0)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _edge_side(plan):
    """The lines of a join's plan from the edges' scan up to the join."""
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "InMemoryTableScan" in x and "dst" in x)
    depth, out = lines[at].index("InMemoryTableScan"), []
    for x in reversed(lines[:at]):
        here = len(x) - len(x.lstrip(" :+-*()0123456789"))
        if here < depth:
            depth = here
            out.append(x.strip())
            if "Join" in x:
                break
    return " ".join(out)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("stored", [False, True])
def test_rounds_neither_move_nor_sort_edges(spark, no_broadcast, tmp_path, stored):
    g = graph(spark, drawn(), 40, directed=True)
    if stored:
        g = g.stored("held", buckets=4, path=str(tmp_path))
    frontier = g.vertices.withColumn("x", F.lit(1))
    with g.dealt("src", "dst", both=True) as edges:
        edges.edges.count()
        edges.back.edges.count()
        for inward in (False, True):
            side = _edge_side(_plan(edge_map(edges, frontier, F.col("x"), F.sum, inward=inward)))
            assert "Join" in side and "Exchange" not in side and "Sort " not in side, side


def test_stored_graphs_give_the_same(spark, tmp_path, monkeypatch):
    from plexspark.operators import edge_map as held
    from plexspark.sources import stored

    for n, (hub, directed) in enumerate(((1 << 20, False), (4, True))):
        monkeypatch.setattr(held, "HUB", hub)
        g = graph(spark, drawn(seed=8), 40, directed)
        own = g.stored(f"kept{n}{int(directed)}", buckets=3, path=str(tmp_path / f"{n}{directed}"))
        again = stored.load(spark, f"kept{n}{int(directed)}")
        assert again.directed == directed and (again.hubs["src"] is not None) == (hub == 4)
        for other in (own, again):
            assert values(other.bfs_parents(3)) == values(g.bfs_parents(3))
            assert sorted(map(tuple, other.edges.collect())) == sorted(map(tuple, g.edges.collect()))
        a, b = values(own.pagerank(3)), values(g.pagerank(3))
        assert a == pytest.approx(b)
        a, b = values(own.betweenness(3, directed)), values(g.betweenness(3, directed))
        assert {v: x for v, x in a.items() if x == x} == pytest.approx({v: x for v, x in b.items() if x == x})
    entries = spark.sql("SHOW TABLES").where("tableName LIKE 'kept%' OR tableName LIKE 'held%'").collect()
    for t in entries:
        spark.sql(f"DROP TABLE {t.tableName}")


def test_a_combine_in_python(spark):
    """The median by position, which messages are combined to where they arrive."""
    import pandas as pd

    @F.pandas_udf("long")
    def middle(x: pd.Series) -> int:
        return sorted(x)[len(x) // 2]

    edges = drawn(seed=9)
    g = graph(spark, edges, 40, directed=True)
    into = defaultdict(set)
    for a, b in edges:
        into[b].add(a)
    want = {v: sorted(u)[len(u) // 2] for v, u in into.items()}
    drop = {(a, a) for a, _ in edges}
    with dealt(g.edges) as held:
        got = values(edge_map(held, g.vertices, F.col("src"), middle))
    assert drop and got == want


def test_the_stress_graph_is_drawn_in_many_tasks(spark):
    g = generators.skewed(spark, 1000, hubs=3, degree=400, seed=2)
    plan = g.edges._jdf.queryExecution().analyzed().toString()
    assert "Range (0, 1200" in plan and g.edges.where("src < 3").count() > 900
    assert generators.uniform(spark, 10, 1).edges.count() == 0
