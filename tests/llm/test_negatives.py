import math
import random

import numpy as np
import pytest
from brute import write
from pyspark.sql import functions as F

from plexspark.llm import negatives
from plexspark.llm.queries import op12_hard_negatives
from plexspark.llm.shared import table

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int"


def expected(rows, every=50):
    """Full search with Python's integers; vec_ids that 7 divides have the next label."""
    own = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    out = []
    most = (1 << 63) - 1
    dot = lambda a, b: max(-most - 1, min(sum(x * y for x, y in zip(a, b, strict=False)), most))
    for i, label, v in {(i, label, tuple(v)) for i, label, v in own if i % every == 0}:
        scored = sorted((-dot(v, w), j, other) for j, other, w in own if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            fit = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            out += [(i, j, rank + 1, n, -p, -s) for rank, (s, n, _) in enumerate(fit)]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def test_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in table(spark, SF, "embeddings").collect()]
    want = expected(rows)
    assert want and got(op12_hard_negatives(spark, SF)) == want


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 40)
    monkeypatch.setattr(negatives, "ASKING", 7)
    monkeypatch.setattr(negatives, "LISTS", 12)
    monkeypatch.setattr(negatives, "ROUNDS", (2, 5, 12))


def test_clusters_ties_and_blocks(spark, tmp_path, small_blocks):
    """Clustered rows, so that lists are skipped; a third of the rows are one vector; few distinct scores."""
    rng = random.Random(1)
    middles = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(9)]
    rows = [(i, [round(x + rng.gauss(0, 0.05), 2) for x in rng.choice(middles)], rng.randrange(3)) for i in range(500)]
    rows += [(i, [0.5] * 6, rng.randrange(3)) for i in range(500, 750)]
    rng.shuffle(rows)
    sf = write(spark, tmp_path, embeddings=spark.createDataFrame(rows, SCHEMA).repartition(5))
    want = expected(spark_rounded(rows))
    assert len(want) > 50 and got(op12_hard_negatives(spark, sf)) == want


def spark_rounded(rows):
    return [(i, v and [x if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_lists_are_skipped(spark, small_blocks, monkeypatch):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(12, 8)) * 3
    x = middles[rng.integers(12, size=600)] + rng.normal(size=(600, 8)) * 0.02
    visits, of = [], negatives._visits
    monkeypatch.setattr(negatives, "_visits", lambda *a: visits.append(of(*a)) or visits[-1])
    counts, counted = [], negatives.cut_counted
    monkeypatch.setattr(negatives, "cut_counted", lambda df: counts.append(counted(df)) or counts[-1])
    rows = [(i, [float(c) for c in v], i % 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = negatives.mine(df, F.col("id") % 20 == 0)
    assert out.count() and sum(n for _, n in counts[:3]) < 30 * 6  # 30 anchors, 12 lists, half of them never visited


def test_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, None], 1), (3, [nan, 1.0], 1), (4, [inf, 1.0], 1), (5, [1.0, 1.0], None), (None, [1.0, 1.0], 1), (6, [], 1), (8, [1.5], 1), (9, [1.0, 2.0], 1), (10, [0.6, 1.2], 2), (11, [0.6, 1.2], 2), (12, [0.9, 1.8, 3.0], 2), (13, [1e20, 1e20], 2), (50, [3e30, 1.0], 1), (100, [-1.0, 0.0], 1), (150, [0.0, 0.0], 7)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS id", "2 AS v", "3 AS list")
    sf = write(spark, tmp_path, embeddings=df)
    want = expected(spark_rounded(rows))
    assert len(want) > 3 and got(op12_hard_negatives(spark, sf)) == want
    assert got(negatives.mine(df.limit(0), F.col("id") % 50 == 0)) == []
    assert got(negatives.mine(df, F.col("id") == 77)) == []


def test_bounds_hold_whatever_the_centroids():
    rng = np.random.default_rng(5)
    x = np.floor(256 * rng.normal(size=(400, 16)))
    centres = negatives.centroids(x, 8)
    own = negatives._spans(x, centres).argmin(axis=1)
    for q in x[::40]:
        for c in range(8):
            inside = x[own == c]
            if len(inside):
                radius = np.sqrt(((inside - centres[c]) ** 2).sum(axis=1)).max()
                assert (abs(inside @ q - q @ centres[c]) <= np.linalg.norm(q) * radius + 1e-6).all()
    assert len(negatives.centroids(np.ones((9, 3)), 4)) == 1
