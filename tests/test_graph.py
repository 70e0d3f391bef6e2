"""Hand graphs with answers by inspection, and random graphs against plain Python."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from plexspark.graph import Graph
from plexspark.operators import frontier
from plexspark.operators.edge_map import edge_map, vertex_map
from plexspark.plans.embedding import wide
from plexspark.plans.shortest import UNREACHED


def graph(spark, edges, n, **options):
    kind = "src long, dst long, weight int" if edges and len(edges[0]) == 3 else "src long, dst long"
    return Graph.from_edges(spark.createDataFrame(edges, kind), n, **options)


def values(df):
    return {r[0]: r[1] for r in df.collect()}


def same(a, b, tolerance=1e-9):
    assert a.keys() == b.keys()
    for k in a:
        assert (math.isnan(a[k]) and math.isnan(b[k])) or a[k] == pytest.approx(b[k], rel=tolerance, abs=tolerance), k


PATH = [(0, 1), (1, 2)]


def test_path_and_isolated_vertex(spark):
    g = graph(spark, PATH, 4)
    assert values(g.bfs(0)) == {0: 0, 1: 1, 2: 2, 3: -1}
    assert values(g.bfs_parents(0)) == {0: 0, 1: 0, 2: 1, 3: -1}
    assert values(g.connected_components()) == {0: 0, 1: 0, 2: 0, 3: 3}
    same(values(g.betweenness(0)), {0: 2.0, 1: 1.0, 2: 0.0, 3: math.nan})
    same(values(g.pagerank(1)), {0: 0.125, 1: 0.5, 2: 0.125, 3: 0.0})
    same(values(g.pagerank(0)), dict.fromkeys(range(4), 0.25))
    assert g.triangle_count().first()[0] == 0
    assert values(g.shortest_paths(0)) == {0: 0, 1: 1, 2: 2, 3: UNREACHED}
    assert values(g.degrees()) == {0: 1, 1: 2, 2: 1, 3: 0}
    assert g.touch_all().first()[0] == 0 + 1 + 1 + 2
    assert g.edge_checksum(frontier.of(spark, [1, 1, 2])).first()[0] == 2 + 2 + 1


def test_triangle_and_k4(spark):
    g = graph(spark, [(0, 1), (1, 2), (0, 2)], 3)
    assert g.triangle_count().first()[0] == 1
    same(values(g.betweenness(0)), {0: 2.0, 1: 0.0, 2: 0.0})
    same(values(g.pagerank(7)), dict.fromkeys(range(3), 1 / 3))
    k4 = graph(spark, [(a, b) for a in range(4) for b in range(a)], 4)
    assert k4.triangle_count().first()[0] == 4
    pairs = spark.createDataFrame([(3, 2), (2, 3), (1, 0), (3, 3)], "a long, b long")
    assert {(r.a, r.b): r.common for r in k4.common_neighbors(pairs).collect()} == {(3, 2): 2, (2, 3): 2, (1, 0): 0, (3, 3): 3}


def test_rules_for_repeated_edges_and_loops(spark):
    twice = [(0, 1, 5), (0, 1, 2), (1, 1, 9), (None, 1, 1), (1, 0, None)]
    rows = lambda g: sorted(tuple(r) for r in g.edges.collect())
    assert rows(graph(spark, twice, 2)) == [(0, 1, 1), (1, 0, 1)]
    assert rows(graph(spark, twice, 2, drop_self_loops=False)) == [(0, 1, 1), (1, 0, 1), (1, 1, 9)]
    assert rows(graph(spark, twice, 2, directed=True)) == [(0, 1, 5), (1, 0, 1), (1, 1, 9)]
    loop = graph(spark, [(0, 0), (0, 1)], 2, drop_self_loops=False)
    assert loop.triangle_count().first()[0] == 0 and values(loop.degrees()) == {0: 2, 1: 1}
    g = graph(spark, [(0, 1, 3)], 3).with_edges(spark.createDataFrame([(1, 0, 8), (2, 2, 1), (1, 2, 4)], "src long, dst long, weight int"))
    assert rows(g) == [(0, 1, 8), (1, 0, 8), (1, 2, 4), (2, 1, 4)]
    asked = spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long")
    assert {(r.src, r.dst): r.present for r in g.has_edges(asked).collect()} == {(0, 1): True, (0, 2): False}
    assert sorted(r.id for r in g.neighbors(1).collect()) == [0, 2]
    assert {r.id: r.neighbors for r in g.adjacency().collect()} == {0: [1], 1: [0, 2], 2: [1]}


def test_directed_components_follow_edges(spark):
    assert values(graph(spark, [(1, 0)], 2, directed=True).connected_components()) == {0: 0, 1: 1}
    assert values(graph(spark, [(0, 1)], 2, directed=True).connected_components()) == {0: 0, 1: 0}
    assert values(graph(spark, [(1, 0)], 2, directed=True).connected_components(weak=True)) == {0: 0, 1: 0}


def test_negative_weights(spark):
    cycle = graph(spark, [(0, 1, 1), (1, 0, -3), (2, 2, 1)], 3, directed=True)
    assert values(cycle.shortest_paths(0)) == dict.fromkeys(range(3), -UNREACHED)
    assert values(cycle.shortest_paths(2)) == {0: UNREACHED, 1: UNREACHED, 2: 0}
    fine = graph(spark, [(0, 1, 4), (0, 2, 1), (1, 3, -3), (2, 3, 2), (3, 4, 0)], 5, directed=True)
    assert values(fine.shortest_paths(0)) == {0: 0, 1: 4, 2: 1, 3: 1, 4: 1}
    long = graph(spark, [(i, i + 1, -1) for i in range(12)], 13, directed=True)
    assert values(long.shortest_paths(0)) == {i: -i for i in range(13)}
    assert set(values(graph(spark, [(0, 1, -1)], 2).shortest_paths(0)).values()) == {-UNREACHED}


def test_errors(spark):
    g = graph(spark, PATH, 3, directed=True)
    for call in (g.bfs, g.bfs_parents, g.shortest_paths):
        with pytest.raises(ValueError):
            call(9)
    with pytest.raises(NotImplementedError):
        g.betweenness(0)
    labels = spark.createDataFrame([(0, 5)], "id long, label int")
    with pytest.raises(ValueError):
        g.gee(labels, 5)
    with pytest.raises(ValueError):
        g.gee(labels, 0)
    with pytest.raises(ValueError):
        graph(spark, [(0, 1, 0)], 2).gee_weighted(labels, 9, laplacian=True)


def test_empty_graph(spark):
    g = graph(spark, [], 0)
    assert g.connected_components().count() == 0 and g.triangle_count().first()[0] == 0 and g.pagerank(3).count() == 0
    assert g.gee(spark.createDataFrame([], "id long, label int"), 2).count() == 0 and g.touch_all().first()[0] == 0


def random_graph(seed, n=40, m=70, weights=(1, 9)):
    rng = random.Random(seed)
    return n, [(rng.randrange(n), rng.randrange(n), rng.randint(*weights)) for _ in range(m)]


def adjacency(n, edges, directed):
    out = {}
    for a, b, w in edges:
        if directed:
            out[a, b] = max(w, out.get((a, b), -(10**9)))
        elif a != b:
            for k in ((a, b), (b, a)):
                out[k] = min(w, out.get(k, 10**9))
    return out


def dijkstra(n, e, s):
    dist, heap = {s: 0}, [(0, s)]
    while heap:
        d, u = heapq.heappop(heap)
        for (a, b), w in e.items():
            if a == u and d + w < dist.get(b, UNREACHED):
                dist[b] = d + w
                heapq.heappush(heap, (d + w, b))
    return {v: dist.get(v, UNREACHED) for v in range(n)}


def brandes(n, e, s):
    depth = {v: d for v, d in dijkstra(n, dict.fromkeys(e, 1), s).items() if d < UNREACHED}
    order = sorted(depth, key=depth.get)
    paths = dict.fromkeys(order, 0.0) | {s: 1.0}
    for v in order[1:]:
        paths[v] = sum(paths[a] for a, b in e if b == v and depth.get(a, -9) == depth[v] - 1)
    delta = dict.fromkeys(order, 0.0)
    for v in reversed(order):
        for a, b in e:
            if b == v and depth.get(a, -9) == depth[v] - 1:
                delta[a] += paths[a] / paths[v] * (1 + delta[v])
    return {v: delta.get(v, math.nan) for v in range(n)}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_undirected(spark, seed):
    n, edges = random_graph(seed)
    e = adjacency(n, edges, False)
    g = graph(spark, edges, n)
    assert values(g.shortest_paths(0)) == dijkstra(n, e, 0)
    depth = {v: -1 if d == UNREACHED else d for v, d in dijkstra(n, dict.fromkeys(e, 1), 0).items()}
    assert values(g.bfs(0)) == depth
    same(values(g.betweenness(0)), brandes(n, e, 0))
    assert sum(v for v in values(g.betweenness(0)).values() if v == v) == pytest.approx(sum(d for d in depth.values() if d > 0))
    triangles = sum((a, b) in e and (b, c) in e and (a, c) in e for a in range(n) for b in range(a) for c in range(b))
    assert g.triangle_count().first()[0] == triangles
    label = {v: (v * 7) % 4 - (v % 5 == 0) for v in range(n)}
    label = {v: x if x >= 0 else -1 for v, x in label.items()}
    size = {k: sum(x == k for x in label.values()) for k in range(4)}
    frame = spark.createDataFrame(list(label.items()), "id long, label int")
    cell = lambda f: {(v, k): sum(f(u, v, w) for (u, x), w in e.items() if x == v and label[u] == k) / size[k] for v in range(n) for k in range(4)}
    as_cells = lambda df: {(r.id, r.cluster): r.value for r in df.collect()}
    deg = {v: sum(w for (a, _), w in e.items() if a == v) for v in range(n)}
    same(as_cells(g.gee(frame, 4)), cell(lambda u, v, w: 2))
    same(as_cells(g.gee_weighted(frame, 4)), cell(lambda u, v, w: 2 * w))
    same(as_cells(g.gee_weighted(frame, 4, laplacian=True)), cell(lambda u, v, w: w / math.sqrt(deg[u] * deg[v])))
    assert all(len(r.embedding) == 4 for r in wide(g.gee(frame, 4)).collect())


def test_random_directed(spark):
    n, edges = random_graph(3, m=90)
    e = adjacency(n, edges, True)
    g = graph(spark, edges, n, directed=True)
    assert values(g.shortest_paths(0)) == dijkstra(n, e, 0)
    same(values(g.betweenness(0, transpose_backward=True)), brandes(n, e, 0))
    label = {v: v for v in range(n)}
    for _ in range(n):
        for a, b in e:
            label[b] = min(label[b], label[a])
    assert values(g.connected_components()) == label
    for divisor, side in (("in", 1), ("out", 0)):
        deg = {v: sum(k[side] == v for k in e) for v in range(n)}
        p = dict.fromkeys(range(n), 1 / n)
        for _ in range(6):
            p = {v: sum(p[a] / deg[a] for a, b in e if b == v and deg[a]) for v in range(n)}
        same(values(g.pagerank(6, divisor)), p)
    known = {v: v % 3 for v in range(n)}
    got = {(r.id, r.cluster): r.value for r in g.gee(spark.createDataFrame(list(known.items()), "id long, label int"), 3).collect()}
    size = {k: sum(x == k for x in known.values()) for k in range(3)}
    want = {(v, k): (sum(b == v and known[a] == k for a, b in e) + sum(a == v and b != v and known[b] == k for a, b in e)) / size[k] for v in range(n) for k in range(3)}
    same(got, want)


def test_frontiers_and_operators(spark):
    g = graph(spark, [(0, 1, 5), (0, 2, 1), (1, 2, 1), (2, 3, 2)], 4, directed=True)
    f = frontier.insert(frontier.single(spark, 0), frontier.of(spark, [0, 1]))
    assert frontier.size(f) == 2 and frontier.non_empty(f) and frontier.out_degree(f, g.edges).first()[0] == 3
    assert sorted(r.id for r in frontier.members(f, g.vertices).collect()) == [0, 1]
    assert values(edge_map(g.edges, f, F.col("weight"), F.sum)) == {1: 5, 2: 2}
    assert values(edge_map(g.edges, f, F.col("weight"), F.max, cond=frontier.of(spark, [1]))) == {2: 1}
    assert values(edge_map(g.edges, None, F.lit(1), F.count, inward=True)) == {0: 2, 1: 1, 2: 1}
    doubled = vertex_map(g.vertices, {"x": F.col("id") * 2}, F.col("id") > 1)
    assert values(doubled) == {2: 4, 3: 6}


def test_hubs_are_spread(spark, monkeypatch):
    """Analytics are the same when the edges of hubs are dealt to several partitions."""
    from plexspark.operators import edge_map as module

    n, edges = 60, [(0, v) for v in range(1, 50)] + [(1, v) for v in range(2, 55)] + [(v, v + 1) for v in range(40, 58)]
    weighted = [(a, b, 1 + (a * 7 + b) % 9) for a, b in edges]
    run = lambda g: [values(g.bfs_parents(3)), values(g.betweenness(3)), values(g.pagerank(2))]
    whole = run(graph(spark, weighted, n))
    monkeypatch.setattr(module, "HUB", 4)
    spread = run(graph(spark, weighted, n))
    for a, b in zip(whole, spread, strict=True):
        same(a, b)
    directed = values(graph(spark, edges, n, directed=True).connected_components())
    monkeypatch.undo()
    assert directed == values(graph(spark, edges, n, directed=True).connected_components())
    monkeypatch.setattr(module, "HUB", 4)
    with module.dealt(graph(spark, edges, n).edges) as held:
        parts = held.edges.groupBy("src", F.spark_partition_id().alias("p")).count()
        assert held.hubs.count() == 2 and parts.agg(F.max("count")).first()[0] < 45 and parts.where("src = 0").count() > 1


def test_common_neighbors_from_either_end(spark):
    edges = [(0, v) for v in range(1, 30)] + [(20, v) for v in (1, 2, 3, 25)]
    g = graph(spark, edges, 31)
    pairs = [(0, 20), (20, 0), (20, 25), (30, 20), (0, 30), (29, 28)]
    near = {v: {b for a, b in edges if a == v} | {a for a, b in edges if b == v} for v in range(31)}
    want = {(a, b): sum(x < min(a, b) for x in near[a] & near[b]) for a, b in pairs}
    assert {(r.a, r.b): r.common for r in g.common_neighbors(spark.createDataFrame(pairs, "a long, b long")).collect()} == want


def test_neighbors_of_a_set(spark):
    g = graph(spark, [(0, 1, 5), (2, 1, 6), (1, 3, 7)], 5, directed=True)
    ids = frontier.of(spark, [1, 4, 1])
    assert [tuple(r) for r in g.neighbors_of(ids).collect()] == [(1, 3, 7)]
    assert sorted(tuple(r) for r in g.neighbors_of(ids, inward=True).collect()) == [(1, 0, 5), (1, 2, 6)]


def exchanges(df):
    """The exchanges of a plan by a key that joins or aggregates ask for."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "hashpartitioning" in line and "ENSURE_REQUIREMENTS" in line]


@pytest.fixture(params=["one cell", "many cells", "many cells and vertices of many neighbours"])
def met(request, monkeypatch):
    from plexspark.plans import triangles

    if request.param != "one cell":
        monkeypatch.setattr(triangles, "HELD", 400)
        monkeypatch.setattr(triangles, "WORTH", 2)
    monkeypatch.setattr(triangles, "MANY", 4 if "vertices" in request.param else 1 << 10)
    monkeypatch.setattr(triangles, "_limit", lambda seen: triangles.MANY)


def near_of(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


def test_triangles_meet_in_cells(spark, met):
    """Counts in any cells; and a list is exchanged for blocks, after which nothing is exchanged but sums."""
    n, edges = 60, [(a, b) for a, b, _ in random_graph(8, 60, 300)[1]] + [(0, v) for v in range(1, 50)]
    g, near = graph(spark, edges, n), near_of(edges)
    corner = {v: sum(y in near[x] for x in near.get(v, ()) for y in near[v] if x < y) for v in range(n)}
    found = g.triangle_count()
    assert found.first()[0] == sum(corner.values()) // 3 and exchanges(found) == []
    assert values(g.triangles_per_vertex()) == corner


def test_common_neighbors_meet_in_cells(spark, met):
    n, edges = 60, [(a, b) for a, b, _ in random_graph(9, 60, 300)[1]] + [(0, v) for v in range(1, 50)] + [(59, v) for v in range(1, 50)]
    g, near = graph(spark, edges, n), near_of(edges)
    pairs = [(a, b) for a in range(0, 60, 3) for b in range(60)] * 2 + [(59, 200), (None, 3), (3, None)]
    want = {(a, b): 0 if None in (a, b) else sum(x < min(a, b) for x in near.get(a, set()) & near.get(b, set())) for a, b in pairs}
    rows = g.common_neighbors(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert {(r.a, r.b): r.common for r in rows} == want and len(rows) == len(want)


def test_common_neighbors_of_edges_are_not_exchanged_by_rows(spark):
    g = graph(spark, [(a, b) for a, b, _ in random_graph(9, 60, 300)[1]], 60).settled()
    found = g.common_neighbors(g.edges.where("src < dst").selectExpr("src AS a", "dst AS b"))
    assert not [line for line in exchanges(found) if "x#" in line] and "collect_set" in found._jdf.queryExecution().executedPlan().toString()


def test_shares_of_classes_are_divided_once(spark):
    """A sum over a class's size, not times one over it, which rounds twice."""
    n = 49
    g = graph(spark, [(v, n) for v in range(n)], n + 1)
    labels = spark.createDataFrame([(v, 0) for v in range(n)] + [(n, 1)], "id long, label int")
    assert {r.id: r.value for r in g.gee_weighted(labels, 2).where("cluster = 0").collect()}[n] == 98 / 49 == 2.0
