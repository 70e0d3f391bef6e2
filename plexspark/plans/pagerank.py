"""PageRank as plain power iteration: no damping, no teleport, a fixed number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexspark.operators.edge_map import edge_map
from plexspark.plans.lineage import cut, held, scratch

#: Rounds between tables; a plan holds so many joins at most.
ROUNDS_APART = 4


def ranks(g, rounds: int = 10, divisor: str | None = None) -> DataFrame:
    """(id, rank) after so many rounds; 1 / n each after none.

    A vertex hands its rank on in equal parts, over its in-degree
    (``divisor="in"``, what undirected graphs use) or its out-degree ("out", the
    default of directed ones). A vertex whose divisor is 0 hands nothing on, and
    one that nothing reaches has 0 after the first round.

    Vertices carry their reciprocal divisor, and edges stay partitioned and
    sorted by src, so that a round exchanges one row per vertex twice and no edge.
    """
    divisor = divisor or ("out" if g.directed else "in")
    n = g.num_nodes()
    side = {"in": "dst", "out": "src"}[divisor]
    degree = g.edges.groupBy(F.col(side).alias("id")).agg((1.0 / F.count("*")).alias("share"))
    own = g.vertices.select("id").join(degree, "id", "left").repartition("id").sortWithinPartitions("id")
    with scratch() as keep, g.dealt("src", "dst") as edges, held(own) as vertices:
        rank = vertices.withColumn("rank", F.lit(1.0 / n if n else 0.0))
        for i in range(rounds):
            sent = edge_map(edges, rank.where("share IS NOT NULL"), F.col("rank") * F.col("share"), F.sum)
            rank = vertices.join(sent, "id", "left").select("id", "share", F.coalesce("value", F.lit(0.0)).alias("rank"))
            if (i + 1) % ROUNDS_APART == 0:
                rank = cut(rank)
        return keep(cut(rank.select("id", "rank")))
