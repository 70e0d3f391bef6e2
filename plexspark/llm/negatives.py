"""Hard-negative mining (operator 12): k-means lists with radii, visited by Cauchy-Schwarz bounds.

All rows lie in inverted lists of k-means centroids, fitted on a bounded sample;
a list knows the largest distance r of a row from its centroid c, so that the
inner product of an anchor q with any of its rows is q.c + |q| r at most and
q.c - |q| r at least. An anchor asks for the best k rows of one or several
windows of scores. It visits lists by falling upper bound, in rounds, passes
over those whose bounds lie outside its windows, and stops once the next bound
is strictly below its k-th score (an equal one could still hold a smaller id).
Nothing is lost by that, so results equal those of a full search.

Lists are dealt to blocks of bounded size, as are the anchors that visit one, so
a list that holds a third of all rows is many tasks. Scores are integers and
exact: products are taken in doubles where these hold every sum, else in
integers of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexspark.llm import shared
from plexspark.plans.lineage import cut_counted

#: Lists, rows that centroids are fitted on at most, and passes over them.
LISTS, SAMPLE, PASSES = 64, 8192, 12
#: Rows of a list and anchors in a task, about.
ROWS, ASKING = 4096, 2048
#: Lists visited up to the end of each round.
ROUNDS = (4, 16, LISTS)
INF = float("inf")


def _scaled(rows: DataFrame, vec_id: str, label: str, vector: str, scale: float) -> tuple[DataFrame, int]:
    """(id, label, v) of the rows that take part, v as doubles in bytes; and the number of components."""
    own = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("x")).where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL")
    wide = own.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            at = np.asarray(lists.offsets, np.int64)
            x = lists.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False).astype(np.float64)
            at -= at[0]
            with np.errstate(all="ignore"):
                x = np.floor(scale * x)
            row = np.repeat(np.arange(len(lists)), np.diff(at))
            out = np.zeros((len(lists), wide))
            out[row, np.arange(len(x)) - at[row]] = x
            fine = np.bincount(row, ~np.isfinite(x), len(lists)) == 0
            keep = pa.array(np.flatnonzero(fine))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array([r.tobytes() for r in out[fine]], pa.binary())], ["id", "label", "v"])

    return own.mapInArrow(run, "id long, label long, v binary"), wide


def _matrix(column: pa.Array | pa.ChunkedArray, wide: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), wide)


def _spans(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of rows from centroids."""
    with np.errstate(all="ignore"):
        square = (x * x).sum(axis=1)[:, None] - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)
    return np.sqrt(np.maximum(np.nan_to_num(square, nan=INF), 0))


def centroids(x: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Lloyd's k-means from rows far from each other; as many centroids as there are different rows at most."""
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    if len(x) <= k:
        return x
    centres, near = x[[rng.integers(len(x))]], np.full(len(x), INF)
    while len(centres) < k:
        near = np.minimum(near, np.nan_to_num(_spans(x, centres[-1:])[:, 0], posinf=1e300))
        share = near / near.max() if near.max() > 0 else np.ones(len(x))
        share = share * share
        centres = np.vstack([centres, x[rng.choice(len(x), p=share / share.sum())]])
    for _ in range(PASSES):
        own = _spans(x, centres).argmin(axis=1)
        size = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def _listed(rows: DataFrame, centres: np.ndarray, wide: int) -> DataFrame:
    """(id, label, v, list, far): each row in the list of its nearest centroid, and its distance from it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(2), wide)
            own, far = np.zeros(len(x), np.int64), np.zeros(len(x))
            for lo in range(0, len(x), 4096):
                span = _spans(x[lo : lo + 4096], centres)
                own[lo : lo + 4096] = span.argmin(axis=1)
                far[lo : lo + 4096] = span.min(axis=1)
            # the square root of a difference is too small by this much at most
            with np.errstate(all="ignore"):
                slack = 1e-6 * np.sqrt((x * x).sum(axis=1) + (centres * centres).sum(axis=1).max(initial=0)) + 1e-6
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own), pa.array(far + slack)], ["id", "label", "v", "list", "far"])

    return rows.mapInArrow(run, "id long, label long, v binary, list long, far double")


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of integers; if doubles can't hold them, exact ones that are capped to longs."""
    if a.size and b.size and abs(a).max() * abs(b).max() * a.shape[1] >= 2.0**53:
        whole = np.frompyfunc(int, 1, 1)
        return np.clip(whole(a) @ whole(b).T, -(1 << 63), (1 << 63) - 1)
    return a @ b.T


WINDOWS = "array<struct<lo:double,hi:double>>"


def _visits(asking: DataFrame, centres: np.ndarray, radius: np.ndarray, wide: int, first: int, last: int) -> DataFrame:
    """``asking`` with a list, for each that the anchor visits as its first to last by upper bound."""
    long = np.sqrt((centres * centres).sum(axis=1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(3), wide)
            with np.errstate(all="ignore"):
                size = np.sqrt((q * q).sum(axis=1))[:, None]
                middle, reach = q @ centres.T, size * radius + 1e-9 * size * long + 1e-6
                top, bottom = np.nan_to_num(middle + reach, nan=INF), np.nan_to_num(middle - reach, nan=-INF)
            place = np.argsort(np.argsort(-top, axis=1, kind="stable"), axis=1)
            go = np.zeros(top.shape, bool)
            for row, windows in enumerate(batch.column(4).to_pylist()):
                for w in windows:
                    go[row] |= (top[row] >= w["lo"]) & (bottom[row] <= w["hi"])
            row, at = np.nonzero(go & (place >= first) & (place < last))
            part = batch.take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(at, pa.int64())], [*batch.schema.names, "list"])

    return asking.mapInArrow(run, f"ask long, id long, label long, v binary, windows {WINDOWS}, list long")


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores; ties by id."""
    if len(score) > 8 * k and score.dtype != object:  # only what is no less than the k-th
        few = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
        return few[np.lexsort((ids[few], -score[few]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _search(asking: DataFrame, lists: DataFrame, centres: np.ndarray, wide: int, k: int, same: bool) -> DataFrame:
    """(ask, window, place, score, id): the first k rows in each window, of the anchor's label or of others, without rows of its id."""
    sizes = lists.groupBy("list").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row a list
    radius, blocks = np.zeros(len(centres)), [1] * len(centres)
    for r in sizes:
        radius[r.list], blocks[r.list] = r.far, -(-r.n // ROWS)
    per = lambda of: F.get(F.array(*map(F.lit, of)), F.col("list").cast("int"))

    def compare(rows: pa.Table, visits: pa.Table) -> pa.Table:
        ask, window, points, ids = [], [], [], []
        if len(rows) and len(visits):
            x, who, kind = _matrix(rows["v"], wide), rows["id"].to_numpy(), rows["label"].to_numpy()
            for lo in range(0, len(visits), 256):
                part = visits.slice(lo, 256)
                found = _exact(_matrix(part["v"], wide), x)
                numbers, own, labels = part["ask"].to_pylist(), part["id"].to_pylist(), part["label"].to_pylist()
                for j, windows in enumerate(part["windows"].to_pylist()):
                    score = found[j]
                    fits = ((kind == labels[j]) if same else (kind != labels[j])) & (who != own[j])
                    for i, w in enumerate(windows):
                        at = np.flatnonzero(fits & (score >= w["lo"]) & (score <= w["hi"]))
                        at = at[_best(score[at], who[at], k)]
                        ask += [numbers[j]] * len(at)
                        window += [i] * len(at)
                        points += [int(s) for s in score[at]]
                        ids += who[at].tolist()
        return pa.table({"ask": pa.array(ask, pa.int64()), "window": pa.array(window, pa.int32()), "score": pa.array(points, pa.int64()), "id": pa.array(ids, pa.int64())})

    hits, first = None, 0
    order = Window.partitionBy("ask", "window").orderBy(F.desc("score"), "id")
    for last in ROUNDS:
        visits, some = cut_counted(_visits(asking, centres, radius, wide, first, last))
        first = last
        if some:
            slices = [1] * len(centres)
            for r in visits.groupBy("list").count().collect():  # a row a list
                slices[r.list] = -(-r["count"] // ASKING)
            left = lists.withColumn("block", F.pmod(F.xxhash64("n"), per(blocks))).withColumn("slice", F.explode(F.sequence(F.lit(0), per(slices) - 1)))
            right = visits.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), per(blocks).cast("long") - 1))).withColumn("slice", F.pmod(F.xxhash64("ask"), per(slices)).cast("int"))
            key = ["list", "block", "slice"]
            met = left.select(*key, "id", "label", "v").groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "ask long, window int, score long, id long")
            hits = met if hits is None else hits.union(met)
        if hits is None:
            continue
        hits = shared.cut(hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place"))
        if last != ROUNDS[-1]:
            full = hits.groupBy("ask", "window").agg(F.count("*").alias("c"), F.min("score").cast("double").alias("kth")).where(F.col("c") >= k)
            full = full.groupBy("ask").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))  # a few windows an anchor
            raised = F.transform("windows", lambda w, i: F.struct(F.greatest(w["lo"], F.coalesce(F.try_element_at("kth", i), F.lit(-INF))).alias("lo"), w["hi"].alias("hi")))
            asking = shared.cut(asking.join(full, "ask", "left").withColumn("windows", raised).drop("kth"))
    if hits is None:
        return lists.sparkSession.createDataFrame([], "ask long, window int, place int, score long, id long")
    return hits.withColumn("place", F.row_number().over(order))


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: float = 256.0, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each anchor and positive.

    A row's components become floor(scale * x); its score is the inner product
    with the anchor; higher scores come first, then smaller ids. ``anchors`` is
    a condition over id and label. An anchor's positives are its first rows of
    the same label, its negatives for a positive of score p the first rows of
    other labels with low * p <= 100 * score <= high * p.

    Rows without an id, label or vector, or with a component that is null or not
    finite (before or after scaling), take no part. Vectors that are shorter
    than others count as filled with zeros. Repeated rows are rows of their own,
    but an anchor is asked for once, and rows of its id are neither its
    positives nor its negatives. Without rows or anchors the result is empty.
    Other columns are ignored. Scores are capped to longs before they are compared.
    """
    with shared.scratch() as keep:
        own, wide = _scaled(rows, vec_id, label, vector, scale)
        own = shared.cut(own)
        sample = own.select("v", F.xxhash64("id", "v").alias("_h")).orderBy("_h").limit(SAMPLE).select("v").collect()
        if not sample:
            return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
        centres = centroids(np.frombuffer(b"".join(bytes(r.v) for r in sample), np.float64).reshape(len(sample), wide), LISTS)
        lists = shared.cut(_listed(own, centres, wide).withColumn("n", F.monotonically_increasing_id()))
        asked = shared.cut(own.where(anchors).distinct().withColumn("ask", F.monotonically_increasing_id()))
        every = F.array(F.struct(F.lit(-INF).alias("lo"), F.lit(INF).alias("hi")))
        good = shared.cut(_search(asked.select("ask", "id", "label", "v", every.alias("windows")), lists, centres, wide, positives, same=True))
        # Decimals hold these products whatever the score is.
        edge = lambda share, side: side(F.col("score").cast("decimal(20,0)") * F.lit(share).cast("decimal(3,0)") / F.lit(100).cast("decimal(3,0)")).cast("double")
        windows = good.select("ask", F.struct("place", edge(low, F.ceil).alias("lo"), edge(high, F.floor).alias("hi")).alias("w"))
        windows = windows.groupBy("ask").agg(F.sort_array(F.collect_list("w")).alias("w"))  # as many as positives
        windows = windows.select("ask", F.transform("w", lambda w: F.struct(w["lo"], w["hi"])).alias("windows"))
        asking = shared.cut(asked.join(windows, "ask").select("ask", "id", "label", "v", "windows"))
        bad = _search(asking, lists, centres, wide, negatives, same=False)
        pairs = asked.select("ask", F.col("id").alias("anchor_id")).join(good.select("ask", (F.col("place") - 1).alias("window"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "ask")
        out = pairs.join(bad.select("ask", "window", F.col("place").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["ask", "window"])
        return keep(shared.cut(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")))
