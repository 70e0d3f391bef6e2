"""Times the headline graph queries: python bench.py prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
threads, BENCH_ITERS the runs of each query (the median counts; no round of
runs starts after BENCH_SECONDS). A first run over the smallest tables compiles
code and isn't counted. ``load`` is the time that making the graph takes, which
is part of each query's figure.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from plexspark import fixtures
from plexspark.queries import QUERIES

HEADLINE = ["bfs_depth", "bc", "pagerank", "cc_min_label", "tc", "bellman_ford", "gee", "gee_weighted", "gee_laplacian", "degree", "edge_checksum", "common_neighbors", "symmetrize_min_weight"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    iters, budget = int(os.environ.get("BENCH_ITERS", "3")), float(os.environ.get("BENCH_SECONDS", "240"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("plexspark-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        QUERIES["bfs_depth"](spark, small).write.format("noop").mode("overwrite").save()
    began = time.perf_counter()
    took: dict[str, list[float]] = {name: [] for name in ["load", *HEADLINE]}
    for n in range(iters):
        if n and time.perf_counter() - began > budget:
            break
        for name, times in took.items():
            at = time.perf_counter()
            made = fixtures.parts(spark, sf_dir, weighted=True).edges if name == "load" else QUERIES[name](spark, sf_dir)
            made.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - at)
            print(name, round(times[-1], 3), file=sys.stderr)
    median = {name: round(statistics.median(times), 3) for name, times in took.items()}
    mean = {name: round(statistics.fmean(times), 3) for name, times in took.items()}
    load = median.pop("load")
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "graph_queries_total", "value": round(sum(median.values()), 3), "unit": "sec", "queries": median, "mean": mean, "load": load, "runs": len(took["load"]), "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
