"""Adjacency files, labels, value files, generators, the command line and streams."""

import random
import os

import pytest

from plexspark import cli
from plexspark.functions.edges import significant
from plexspark.graph import Graph
from plexspark.sources import adj, generators
from plexspark.streaming import ingest


def put(tmp_path, text, name="g.adj"):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def lines(path):
    out = []
    for name in sorted(n for n in os.listdir(path) if n.startswith("part-")):
        out += open(f"{path}/{name}").read().splitlines()
    return out


def edges(g):
    return sorted(tuple(r) for r in g.edges.collect())


def test_read(spark, tmp_path):
    path = put(tmp_path, "AdjacencyGraph 3\t4\n\n0 1\r\n3 1 0\x002 1\n")
    g = adj.read_adj(spark, path)
    assert edges(g) == [(0, 1), (1, 0), (1, 2), (2, 1)] and g.num_nodes() == 3
    assert edges(adj.read_adj(spark, path, weighted=True))[0] == (0, 1, 1)
    path = put(tmp_path, "WeightedAdjacencyGraph\n4\n3\n0\n2\n2\n3\n1\n3\n0\n7\n-8\n9\n")
    assert edges(adj.read_adj(spark, path, symmetric=False)) == [(0, 1, 7), (0, 3, -8), (2, 0, 9)]
    assert edges(adj.read_adj(spark, path, weighted=False, symmetric=False)) == [(0, 1), (0, 3), (2, 0)]


@pytest.mark.parametrize("text", ["Graph 1 1 0 0", "AdjacencyGraph 0 1 0", "AdjacencyGraph 1 0 0", "AdjacencyGraph 2 2 0 1 1", "WeightedAdjacencyGraph 2 2 0 1 1 0", "AdjacencyGraph 2 2 0 1 1 x", "AdjacencyGraph 2 2 1 0 1 0", "AdjacencyGraph 2 2 0 1 1 2", "AdjacencyGraph", ""])
def test_faulty_files(spark, tmp_path, text):
    with pytest.raises(ValueError):
        adj.read_adj(spark, put(tmp_path, text))


def test_round_trip_over_many_files(spark, tmp_path):
    g = generators.uniform(spark, 500, 6, seed=3)
    adj.write_adj(g, str(tmp_path / "out"))
    assert edges(adj.read_adj(spark, str(tmp_path / "out"))) == edges(g)
    few = Graph.from_edges(spark.createDataFrame([(1, 3, 5), (3, 4, 2)], "src long, dst long, weight int"), 7, directed=True)
    adj.write_adj(few, str(tmp_path / "few"), one_file=True)
    assert lines(tmp_path / "few") == "WeightedAdjacencyGraph 7 2 0 0 1 1 2 2 2 3 4 5 2".split()
    assert edges(adj.read_adj(spark, str(tmp_path / "few"), symmetric=False)) == edges(few)


def test_generators(spark):
    a, b = generators.uniform(spark, 200, 9, seed=1), generators.uniform(spark, 200, 9, seed=1)
    assert edges(a) == edges(b) != edges(generators.uniform(spark, 200, 9, seed=2))
    assert 200 * 4 < a.num_edges() <= 200 * 8 and a.num_nodes() == 200
    s = generators.skewed(spark, 1000, 3, 400)
    assert s.num_nodes() == 1000 and min(r.degree for r in s.degrees().where("id < 3").collect()) > 250
    assert generators.uniform(spark, 5, 1).num_edges() == 0


def test_values_and_labels(spark, tmp_path):
    cases = [(0.0, "0"), (1.0, "1"), (77359.0, "77359"), (123456.0, "123456"), (1234567.0, "1.23457e+06"), (0.0001234567, "0.000123457"), (0.00001, "1e-05"), (-2.5, "-2.5"), (999999.7, "1e+06"), (0.1 + 0.2, "0.3"), (float("nan"), "nan"), (float("-inf"), "-inf"), (1e100, "1e+100"), (3.14159265, "3.14159")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "id long, x double")
    assert [r.s for r in df.select("id", significant(df.x).alias("s")).orderBy("id").collect()] == [s for _, s in cases]
    adj.write_values(df, str(tmp_path / "v"), one_file=True)
    assert lines(tmp_path / "v") == [s for _, s in cases]
    labels = adj.read_labels(spark, put(tmp_path, "3 -1\n0", "y"))
    assert sorted(tuple(r) for r in labels.collect()) == [(0, 3), (1, -1), (2, 0)]


def test_command_line(spark, tmp_path, capsys):
    path = put(tmp_path, "AdjacencyGraph 4 4 0 1 3 4 1 0 2 1")
    y = put(tmp_path, "0 1 0 -1", "y")
    common = ["-g", path, "--iters", "1", "--output", str(tmp_path)]
    cli.main([*common, "--algorithm", "bfs", "--src", "0"], spark)
    assert lines(tmp_path / "bfs.out") == ["0", "1", "2", "-1"] and "median" in capsys.readouterr().out
    cli.main([*common, "--algorithm", "tc"], spark)
    assert capsys.readouterr().out.startswith("0\n")
    cli.main([*common, "--algorithm", "bf", "-w"], spark)
    assert lines(tmp_path / "bf.out") == ["0", "1", "2", "1073741823"]
    cli.main([*common, "--algorithm", "gee", "--nClusters", "2", "--y_location", y], spark)
    assert lines(tmp_path / "gee.out") == ["0.000000 2.000000", "2.000000 0.000000", "0.000000 2.000000", "0.000000 0.000000"]
    for faulty in (["--algorithm", "nothing"], ["--algorithm", "bf"], ["--algorithm", "gee"]):
        with pytest.raises(ValueError):
            cli.main([*common, *faulty], spark)


def test_stream_of_edges(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 3), (1, 0, 2), (2, 2, 1), (1, 2, 4)], "src long, dst long, weight int")
    rows.write.parquet(str(tmp_path / "in" / "a"))
    stream = spark.readStream.schema(rows.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest(stream, str(tmp_path / "table"), str(tmp_path / "state")).awaitTermination()
    run()
    assert edges(ingest.load(spark, str(tmp_path / "table"), 3)) == [(0, 1, 2), (1, 0, 2), (1, 2, 4), (2, 1, 4)]
    spark.createDataFrame([(0, 1, 9)], rows.schema).write.parquet(str(tmp_path / "in" / "b"))
    run()
    assert edges(ingest.load(spark, str(tmp_path / "table"), 3)) == [(0, 1, 9), (1, 0, 9), (1, 2, 4), (2, 1, 4)]
    q = ingest.degree_counts(stream).writeStream.outputMode("complete").format("memory").queryName("deg").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.id: r.edges for r in spark.table("deg").collect()} == {0: 2, 1: 2, 2: 1}


def test_command_line_writes_ordered_parts(spark, tmp_path):
    n = 300
    g = str(tmp_path / "path.adj")
    starts = [max(0, 2 * i - 1) for i in range(n)]
    ends = [j for i in range(n) for j in (i - 1, i + 1) if 0 <= j < n]
    with open(g, "w") as f:
        f.write("\n".join(["AdjacencyGraph", *map(str, [n, len(ends), *starts, *ends])]) + "\n")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    text = {}
    try:
        for one in (False, True):
            out = tmp_path / f"out{one}"
            cli.main(["-g", g, "--algorithm", "pr", "--pr_rounds", "1", "--iters", "1", "--output", str(out), *["--one_file"] * one], spark)
            files = sorted((out / "pr.out").glob("part-*"))
            assert (len(files) == 1) == one
            text[one] = "".join(f.read_text() for f in files).split()
        assert len(text[True]) == n and text[True] == text[False]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_a_file_on_one_line_is_split(spark, tmp_path):
    n = 3000
    text = " ".join(["AdjacencyGraph", str(n), str(n), *map(str, range(n)), *(str((i + 1) % n) for i in range(n))])
    path = put(tmp_path, text)
    assert adj.separator(spark, path) == " " and adj.separator(spark, put(tmp_path, text.replace(" ", "\n"), "h.adj")) == "\n"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        assert spark.read.text(path, lineSep=" ").rdd.getNumPartitions() > 3
        assert edges(adj.read_adj(spark, path, symmetric=False)) == [(i, (i + 1) % n) for i in range(n)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_a_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        adj.read_adj(spark, f"{tmp_path}/none.adj")


def test_tables_go_with_their_scope(spark):
    from plexspark.plans import lineage

    there = lambda df: os.path.isdir(lineage._path[df].removeprefix("file:"))
    with lineage.scratch() as keep:
        a, b = lineage.cut(spark.range(3)), keep(lineage.cut(spark.range(4)))
        with lineage.scratch():
            c = lineage.cut(spark.range(5))
            assert there(a) and there(b) and there(c)
        assert there(a) and not there(c)
    assert not there(a) and there(b) and b.count() == 4
    counted, n = lineage.cut_counted(spark.range(7))
    assert n == 7 and lineage.cut_counted(spark.range(0))[1] == 0
    where = lineage._path[counted].removeprefix("file:")
    lineage.drop(counted, spark.range(1))
    assert not os.path.isdir(where)


def test_words_of_any_layout_in_any_ranges(spark, tmp_path):
    from plexspark.sources import words as ranges

    rng = random.Random(4)
    for trial in range(40):
        data = "".join(rng.choice(["a", "bb", "cdé", "x" * 40, " ", "\n", "\t", "\r\n", "\x00", " "]) for _ in range(rng.randint(0, 60))).encode()
        path = tmp_path / f"w{trial}"
        path.write_bytes(data)
        want = data.translate(bytes.maketrans(b"\t\r\n\x00", b"    ")).split()
        for size in (1, 2, 3, 7, 64, 1 << 20):
            got = [w for r in ranges.WordReader(str(path), size).partitions() for found in ranges.ranged(str(path), r.path, r.start, r.end) for w in found]
            assert got == want, (data, size)


def test_a_file_is_split_wherever_lines_break(spark, tmp_path):
    n = 3000
    offsets, ends = "\n".join(str(i) for i in range(n)), " ".join(str((i + 1) % n) for i in range(n))
    layouts = {"mixed": f"AdjacencyGraph\n{n}\n{n}\n{offsets}\n{ends}\n", "tabs": f"AdjacencyGraph\n{n}\n{n}\n{offsets}\n{ends}".replace("\n", "\t").replace(" ", "\t")}
    for name, text in layouts.items():
        (tmp_path / name).write_text(text)
        found = adj.words(spark, str(tmp_path / name), size=1024)
        assert found.count() == 3 + 2 * n
        g = adj.graph_of(spark, name, found, symmetric=False)
        assert sorted(map(tuple, g.edges.collect())) == [(i, (i + 1) % n) for i in range(n)]
        read = spark.read.format("blank_words").option("path", str(tmp_path / name)).option("range", "1024").load()
        assert read.rdd.getNumPartitions() > 10 and read.groupBy("block").count().agg({"count": "max"}).first()[0] < 600


def test_halves_are_printed_by_their_exact_value(spark, tmp_path):
    xs = [0.2890625, 0.1734375, 0.0000005, 0.0000015, 0.0046875, 2.5, -0.0703125, 1.0000005]
    cells = spark.createDataFrame([(0, i, x) for i, x in enumerate(xs)], "id long, cluster int, value double")
    adj.write_embedding(cells, str(tmp_path / "e"))
    assert lines(tmp_path / "e") == [" ".join("%.6f" % x for x in xs)]
    assert lines(tmp_path / "e")[0].startswith("0.289062 0.173437 ")
    ys = [10.03125, 1.000005, 2.000015, 1234567.5, 100000.5, 0.00001000005, None]
    adj.write_values(spark.createDataFrame(list(enumerate(ys)), "id long, x double"), str(tmp_path / "v"), one_file=True)
    assert open(next((tmp_path / "v").glob("part-*"))).read().splitlines()[:6] == ["%g" % y for y in ys[:6]]
    assert lines(tmp_path / "v")[0] == "10.0312"


@pytest.mark.parametrize("one", [False, True])
def test_words_are_written_in_order_without_places(spark, tmp_path, one):
    """Edges are exchanged once for a file, by their own order; many part files, vertices without edges, weights."""
    rng = random.Random(5)
    rows = sorted({(rng.randrange(1, 90), rng.randrange(90)): rng.randint(-9, 9) for _ in range(600)}.items())
    g = Graph.from_edges(spark.createDataFrame([(a, b, w) for (a, b), w in rows], "src long, dst long, weight int").repartition(7), 100, directed=True)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        adj.write_adj(g.settled(), str(tmp_path / "g"), one_file=one)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    starts = [sum(a < v for (a, _), _ in rows) for v in range(100)]
    want = ["WeightedAdjacencyGraph", "100", str(len(rows)), *map(str, starts), *(str(b) for (_, b), _ in rows), *(str(w) for _, w in rows)]
    assert lines(tmp_path / "g") == want and (len(list((tmp_path / "g").glob("part-*"))) == 1) == one
    found = adj.words(spark, str(tmp_path / "g"))
    assert sorted(tuple(r) for r in found.collect()) == list(enumerate(want))
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_ends_that_belong_to_no_vertex_are_not_judged(spark, tmp_path):
    path = put(tmp_path, "AdjacencyGraph 2 2 1 1 9 0")
    assert edges(adj.read_adj(spark, path, symmetric=False)) == [(1, 0)]
    with pytest.raises(ValueError, match="outside"):
        adj.read_adj(spark, put(tmp_path, "AdjacencyGraph 2 2 1 1 0 9", "h.adj"), symmetric=False)
