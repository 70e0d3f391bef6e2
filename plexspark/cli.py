"""Run an analytic over an adjacency file: ``python -m plexspark.cli -g FILE --algorithm bfs --src 1``."""

from __future__ import annotations

import argparse
import statistics
import time

from pyspark.sql import SparkSession

from plexspark.sources import adj, generators

PLAIN = {"bfs": "bfs.out", "bc": "bc.out", "pr": "pr.out", "cc": "cc.out", "tc": None, "gee": "gee.out"}
WEIGHTED = {"bf": "bf.out", "gee": "gee_weighted.out"}


def run(g, algorithm: str, weighted: bool, src: int, rounds: int, labels, k: int, laplacian: bool):
    if algorithm not in (WEIGHTED if weighted else PLAIN):
        raise ValueError(f"unknown algorithm {algorithm!r} for {'weighted' if weighted else 'unweighted'} graphs")
    if algorithm == "gee":
        if labels is None:
            raise ValueError("gee needs --y_location")
        return g.gee_weighted(labels, k, laplacian) if weighted else g.gee(labels, k)
    calls = {"bfs": lambda: g.bfs(src), "bc": lambda: g.betweenness(src), "pr": lambda: g.pagerank(rounds), "cc": g.connected_components, "tc": g.triangle_count, "bf": lambda: g.shortest_paths(src)}
    return calls[algorithm]()


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--src", type=int, default=0)
    p.add_argument("--iters", type=int, default=10)
    p.add_argument("--pr_rounds", type=int, default=10)
    p.add_argument("-g", "--graph", required=True, help="an adjacency file, or skew for a generated graph with 100 hubs")
    p.add_argument("--algorithm", required=True)
    p.add_argument("-w", "--weights", action="store_true")
    p.add_argument("-s", "--symmetric", "--symetric", default=True, type=lambda x: str(x).lower() not in ("false", "0", "no"))
    p.add_argument("--nClusters", type=int, default=0)
    p.add_argument("--y_location", default="")
    p.add_argument("--laplacian", action="store_true")
    p.add_argument("--dump_output", default=True, type=lambda x: str(x).lower() not in ("false", "0", "no"))
    p.add_argument("--output", default=".", help="folder of the result")
    p.add_argument("--one_file", action="store_true", help="write the result as one file, in one task, instead of part files in order")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("plexspark").getOrCreate()
    if a.graph == "skew":
        g = generators.skewed(spark).settled()
    else:
        g = adj.read_adj(spark, a.graph, weighted=a.weights, symmetric=a.symmetric).settled()
    labels = adj.read_labels(spark, a.y_location) if a.y_location else None
    took = []
    for i in range(a.iters):
        began = time.perf_counter()
        out = run(g, a.algorithm, a.weights, a.src, a.pr_rounds, labels, a.nClusters, a.laplacian)
        out.write.format("noop").mode("overwrite").save()
        took.append(time.perf_counter() - began)
        name = (WEIGHTED if a.weights else PLAIN)[a.algorithm]
        if i == 0 and a.dump_output:
            if name is None:
                print(out.first()[0])
            elif a.algorithm == "gee":
                adj.write_embedding(out, f"{a.output}/{name}", one_file=a.one_file)
            else:
                adj.write_values(out, f"{a.output}/{name}", one_file=a.one_file)
    print(f"median {sorted(took)[len(took) // 2]:.6f} s, mean {statistics.fmean(took):.6f} s")


if __name__ == "__main__":
    main()
