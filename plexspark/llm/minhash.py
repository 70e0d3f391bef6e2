"""MinHash near-dedup (operator 7): fast similarity sketches, bands, exact links.

The sketch has ``BANDS * ROWS`` coordinates. In round i every shingle of a set
is thrown into a random coordinate with a random value, i in front of it, and
the least value of each coordinate stays; later rounds thus only fill what is
still empty, and rounds beyond the number of coordinates throw all shingles
into one coordinate after the other, so every coordinate is filled for sure.
Large sets are done after one round or two. Equal coordinates of two sketches
estimate the similarity with the concentration of independent samples.

Bands of ``ROWS`` coordinates select candidates: with 40 bands of 6 a pair of
similarity 0.8 is missed once in 190,000 times. Texts of the same words (told
by their SHA-256) are one node before that. A band's bucket is not expanded into pairs: it has a centre, and a
node is compared with the centres that most of its buckets have, exactly and on
whole texts; then, after components are known, with centres in other
components, for some rounds. Among
what is still apart an exact prefix filter selects pairs between components, so
no link that joins two of them is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexspark.llm import shared, words
from plexspark.plans.connected import components
from plexspark.plans.lineage import cut_counted, cut_observed

BANDS, ROWS = 40, 6
#: Further rounds in which a node is compared with centres of its buckets, and with how many: those that most of them have.
STARS, PICKS = 1, 16
#: Sets whose sizes differ by less than this factor lie in one class of sizes.
CLASS = 1.05
#: Pairs of one node that are compared in a task, about.
TOGETHER = 1024
#: Ids that may be null (``shared.orderly``), and nodes.
ID = "struct<none:boolean,value:long>"
NODE = f"struct<id:{ID},hash:long>"
U = np.uint64
EMPTY = U((1 << 64) - 1)


def shingle_sets(buf: np.ndarray, at: np.ndarray, size: int, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row and the row of each, by row; a row with fewer words is one shingle."""
    buf = words.LOWER[buf] if lower else buf
    w = words.words_of(buf, at)
    each = words.span_hashes(buf, w.start, w.end)
    begin = words.window_starts(w, size)
    few = np.flatnonzero((w.counts > 0) & (w.counts < size))
    h = np.r_[words.run_hashes(each, size)[begin] if len(begin) else begin.astype(U), words.span_hashes(each, w.first[few], w.first[few + 1])]
    row = np.r_[w.doc[begin], few]
    keep = np.unique(h ^ words.mix(row, 9), return_index=True)[1]
    keep = keep[np.argsort(row[keep], kind="stable")]
    return h[keep], row[keep]


def sketches(h: np.ndarray, row: np.ndarray, rows: int, width: int) -> np.ndarray:
    """A sketch of ``width`` coordinates for each row; those of rows without shingles stay empty."""
    out = np.full(rows * width, EMPTY, U)
    for i in range(2 * width):
        if not len(h):
            break
        x = words.mix(h, i + 11)
        place = (((x >> U(40)) * U(width)) >> U(24)).astype(np.int64) if i < width else np.full(len(h), i - width)
        np.minimum.at(out, row * width + place, (U(i) << U(40)) | (x & U((1 << 40) - 1)))
        full = (out.reshape(rows, width) != EMPTY).all(axis=1)
        left = ~full[row]
        h, row = h[left], row[left]
    return out.reshape(rows, width)


def bands(sketch: np.ndarray, n: int, rows: int) -> np.ndarray:
    out = np.empty((len(sketch), n), U)
    for b in range(n):
        key = np.full(len(sketch), words.mix(np.array([b]), 21)[0], U)
        for j in range(b * rows, (b + 1) * rows):
            key = words.mix(key ^ sketch[:, j])
        out[:, b] = key
    return out


def _survey(docs: DataFrame, size: int, lower: bool) -> DataFrame:
    """(id, hash, n, sha, bands) of (id, hash, text): one pass, without a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, at in shared.passes(batch):
                rows = part.num_rows
                h, row = shingle_sets(buf, at, size, lower)
                n = np.bincount(row, minlength=rows)
                raw = (words.LOWER[buf] if lower else buf).tobytes()
                sha = [hashlib.sha256(b" ".join(raw[a:b].split())).digest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                keys = bands(sketches(h, row, rows, BANDS * ROWS), BANDS, ROWS).view(np.int64)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), lists], ["id", "hash", "n", "sha", "bands"])

    return docs.mapInArrow(run, f"id {ID}, hash long, n long, sha binary, bands array<long>")


def shingles_of(text: str, size: int, lower: bool) -> frozenset:
    w = (text or "").encode().lower().split() if lower else (text or "").encode().split()  # bytes: A-Z and the six spaces only
    return frozenset(zip(*(w[i:] for i in range(size)), strict=False)) if len(w) >= size else frozenset([tuple(w)] if w else [])




def _with_text(pairs: DataFrame, texts: DataFrame, side: str, other: str, into: str) -> DataFrame:
    """``pairs`` with the text of one side; a node of many pairs is dealt to parts by the other side, and its text copied to each."""
    texts = texts.select(F.col("node").alias(side), F.col("text").alias(into))
    often, some = cut_counted(pairs.groupBy(side).agg(F.count("*").alias("_c")).where(F.col("_c") > TOGETHER))
    if not some:
        return pairs.join(texts, side)
    deal = F.coalesce(F.ceil(F.col("_c") / TOGETHER).cast("int"), F.lit(1))
    texts = texts.join(often, side, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), deal - 1))).drop("_c")
    dealt = shared.join_counted(pairs, often, side, "_c", "left").withColumn("_part", F.pmod(F.xxhash64(other), deal).cast("int")).drop("_c")
    return dealt.join(texts, [side, "_part"]).drop("_part")


def _exact(pairs: DataFrame, texts: DataFrame, size: int, lower: bool, percent: int) -> tuple[DataFrame, int]:
    """(a, b, linked) for each of the pairs, compared on whole texts; and how many are linked."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, frozenset())
        for batch in batches:
            linked = []
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if y != last[0]:  # rows come by b
                        last = y, shingles_of(y, size, lower)
                    s, t = shingles_of(x, size, lower), last[1]
                    common = len(s & t)
                    linked.append(100 * common >= percent * (len(s) + len(t) - common) and common > 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    pairs = shared.cut(pairs.select("a", "b"))
    both = _with_text(_with_text(pairs, texts, "a", "b", "x"), texts, "b", "a", "y")
    out, seen = cut_observed(both.select("a", "b", "x", "y").mapInArrow(run, f"a {NODE}, b {NODE}, linked boolean"), linked=F.count_if("linked"))
    return out, seen["linked"]


def _shingled(texts: DataFrame, size: int, lower: bool) -> DataFrame:
    """(node, n, h) for each distinct shingle of (node, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, at in shared.passes(batch):
                h, row = shingle_sets(buf, at, size, lower)
                n = np.bincount(row, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(n[row], pa.int64()), pa.array(h.view(np.int64))], ["node", "n", "h"])

    return texts.mapInArrow(run, f"node {NODE}, n long, h long")


def _overlap(n: Column, m: Column, percent: int) -> Column:
    """What sets of n and m shingles have in common at least if they are that similar."""
    return F.ceil(F.lit(percent) * (n + m) / (100 + percent))


def _rest(known: DataFrame, texts: DataFrame, size: int, lower: bool, percent: int) -> DataFrame:
    """(a, b) for all nodes of ``known`` (node, component) in different components that may be linked.

    Prefix filter: sets of n and m shingles whose overlap is t at least share
    one of the n - t + 1 rarest of one and the m - t + 1 rarest of the other.
    t grows with both sizes, so a set looks for smaller ones by classes of their
    sizes, with no more of its shingles than that class needs, and is found by
    larger ones under what sets of its own size need. What a family of texts has
    in common thus meets only if they are near the limit. At most one of a pair
    is in the component that holds most of a shingle's sets, so two members of
    that never meet.
    """
    sets = shared.cut(_shingled(texts.join(known.select("node"), "node", "left_semi"), size, lower))
    often = shared.cut(sets.groupBy("h").agg(F.count("*").alias("df")))
    rare = shared.join_counted(sets, often, "h", "df").withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("df", "h")))
    n, m, rank, place = F.col("n"), F.col("m"), F.col("rank"), F.col("place")
    least = F.ceil(n * percent / 100)
    rare = rare.where((rank <= n - least + 1) & (F.col("df") > 1))
    rare = shared.cut(rare.join(known, "node").select("h", "node", "n", "rank", "component"))
    most = rare.groupBy("h", "component").agg(F.count("*").alias("c")).groupBy("h").agg(F.max_by("component", "c").alias("most"), F.count("*").alias("parts"), F.sum("c").alias("c"))
    most = shared.cut(most.where("parts > 1").select("h", "most", "c"))
    rare = shared.cut(shared.join_counted(rare, most, "h", "c").withColumn("main", F.col("component") == F.col("most")).drop("most", "c"))
    kind = lambda x: F.floor(F.log(x) / F.log(F.lit(CLASS))).cast("int")
    small = rare.where(rank <= n - _overlap(n, n, percent) + 1)
    small = small.select("h", kind(n).alias("kind"), F.col("node").alias("a"), n.alias("m"), rank.alias("place"), F.col("component").alias("other"), F.col("main").alias("also"))
    large = rare.withColumn("kind", F.explode(F.sequence(kind(least), kind(n))))
    smallest = F.greatest(least, F.ceil(F.pow(F.lit(CLASS), "kind") * (1 - 1e-9)))
    large = large.where(rank <= n - _overlap(n, smallest, percent) + 1)
    fits = (F.col("component") != F.col("other")) & (m <= n) & (F.least(n - rank, m - place) + 1 >= _overlap(n, m, percent))
    met = [large.where(~F.col("main")).join(small, ["h", "kind"]).where(fits), large.where("main").join(small.where("NOT also"), ["h", "kind"]).where(fits)]
    return met[0].union(met[1]).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct()


def _centres(pairs: DataFrame) -> DataFrame:
    """(a, b): for each node of (a, node) the PICKS that it has most often."""
    often = pairs.groupBy("node", "a").agg(F.count("*").alias("c"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("c"), "a"))
    return often.withColumn("place", place).where(F.col("place") <= PICKS).select("a", F.col("node").alias("b"))


def _merged(whole: DataFrame, links: DataFrame) -> DataFrame:
    """``whole`` (node, component) with further links (a, b), which are searched between components only."""
    of = lambda c: whole.select(F.col("node").alias(c), F.col("component").alias(f"_{c}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    ends = shared.cut(ends.select("a", "b", F.coalesce("_a", "a").alias("x"), F.coalesce("_b", "b").alias("y")))
    over = components(ends, "x", "y").select(F.col("node").alias("component"), F.col("component").alias("least"))
    fresh = ends.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("x").alias("component")), F.struct(F.col("b").alias("node"), F.col("y").alias("component")))).alias("n")).select("n.*")
    every = whole.union(fresh).distinct()
    return shared.cut(every.join(over, "component", "left").select("node", F.coalesce("least", "component").alias("component")))


def _alike(percent: int):
    """Whether sets of n and m shingles can have that similarity."""
    n, m = F.col("n"), F.col("m")
    return (F.lit(100) * n >= F.lit(percent) * m) & (F.lit(100) * m >= F.lit(percent) * n)


def _labelled(docs: DataFrame, doc_id: str, text: str, size: int, percent: int, lower: bool) -> tuple[DataFrame, DataFrame]:
    """(id, hash, n, sha) of all rows, and (sha, root) for those with words."""
    base = docs.select(shared.orderly(doc_id).alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    rows = shared.cut(_survey(base, size, lower))
    with shared.scratch() as keep:
        label = keep(_grouped(rows, base, size, lower, percent))
    return rows.select("id", "hash", "n", "sha"), label


def _grouped(rows: DataFrame, base: DataFrame, size: int, lower: bool, percent: int) -> DataFrame:
    """(sha, root) for the texts of ``rows``: the least node (id, hash) of those that are linked with it."""
    nodes = rows.where("n > 0").groupBy("sha").agg(F.min(F.struct("id", "hash")).alias("node"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = shared.cut(nodes)

    banded = nodes.select("node", "n", F.explode("bands").alias("key"))
    heads = shared.cut(banded.groupBy("key").agg(F.count("*").alias("c"), F.min(F.struct("node", "n")).alias("head")).where("c > 1"))
    members = shared.cut(banded.join(heads, "key").select("key", "node", "n", "c", F.col("head.node").alias("head"), F.col("head.n").alias("m")))
    texts = base.select(F.struct("id", "hash").alias("node"), "text").join(members.select("node").distinct(), "node", "left_semi")
    texts = shared.cut(texts.groupBy("node").agg(F.first("text").alias("text")))

    near = members.where("node <> head").where(_alike(percent)).select(F.col("head").alias("a"), "node", "c")
    pairs = near.where("c = 2").select("a", F.col("node").alias("b")).union(_centres(near.where("c > 2"))).distinct()
    checked, _ = _exact(pairs, texts, size, lower, percent)
    whole = components(checked.where("linked"))
    members = members.where("c > 2").drop("c", "head", "m")  # of two nodes nothing is left to compare
    for turn in range(STARS + 1):
        known = members.join(whole.select("node", "component"), "node", "left").withColumn("component", F.coalesce("component", "node"))
        order = F.xxhash64("node", F.lit(turn))
        apart = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min(F.struct(order, F.struct("node", "n", "component"))).alias("pick"))
        apart, some = cut_counted(apart.where("lo <> hi").select("key", F.col("pick.col2.node").alias("a"), F.col("pick.col2.n").alias("m"), F.col("pick.col2.component").alias("other")))
        if not some:
            break
        members = shared.cut(known.join(apart.select("key"), "key", "left_semi").select("key", "node", "n", "component"))
        if turn < STARS:
            pairs = members.join(apart, "key").where((F.col("component") != F.col("other")) & _alike(percent)).select("a", "node")
            pairs = _centres(pairs)
        else:
            pairs = _rest(members.select("node", "component").distinct(), texts, size, lower, percent)
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().join(checked, ["a", "b"], "left_anti")
        more, linked = _exact(pairs, texts, size, lower, percent)
        checked = checked.union(more)
        if linked:
            whole = _merged(whole, more.where("linked"))
        members = members.drop("component")

    return shared.cut(nodes.select("sha", "node").join(whole, "node", "left").select("sha", F.coalesce("component", "node").alias("root")))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Two rows are linked if they share ``percent`` of their distinct shingles of
    ``size`` words (A-Z lower-cased), which is confirmed on their texts.
    component_id is the smallest doc_id that links reach; kept: it is the row's
    own. A null, empty or blank text has no shingles and no links. A null doc_id
    is never a component's smallest unless all of it are null, and such a row is
    kept then only. Rows that repeat a doc_id are rows of their own; ids are cast to
    long; an empty table gives an empty one. Other columns are dropped.
    """
    rows, label = _labelled(docs, doc_id, text, size, percent, lower)
    out = rows.where("n > 0").join(label, "sha").select("id", "n", F.col("root.id").alias("least")).union(rows.where("n = 0").select("id", "n", "id"))
    value = lambda c: F.when(~F.col(c)["none"], F.col(c)["value"])
    return out.select(value("id").alias(doc_id), F.col("n").alias("n_shingles"), value("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))


def first_of_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """One row of ``docs`` for each group of ``near_duplicates``, with all its columns: of the smallest doc_id (null comes last).

    If rows of the group repeat that doc_id, one stays: the one whose text has
    the least hash. Rows without words are in no group and all stay. A column
    ``_hash`` or ``_id`` of the input is dropped.
    """
    rows, label = _labelled(docs, doc_id, text, size, percent, lower)
    lead = rows.where("n > 0").join(label, "sha").where("id = root.id").groupBy("root", "id", "hash").agg(F.count("*").alias("c"))
    lead = lead.groupBy("root").agg(F.min(F.struct("hash", "id", "c")).alias("k")).select(F.col("k.id").alias("_id"), F.col("k.hash").alias("_hash"), F.col("k.c").alias("c"))
    lead = shared.cut(lead.union(rows.where("n = 0").select("id", "hash", F.lit(1).cast("long")).distinct()))
    own = docs.drop("_id", "_hash")
    names = own.columns
    own = own.withColumns({"_id": shared.orderly(doc_id), "_hash": F.xxhash64(text)})
    key = ["_id", "_hash"]
    once = own.join(lead.where("c = 1"), key, "left_semi")
    again = own.join(lead.where("c > 1"), key, "left_semi").dropDuplicates(key)  # aggregated before it is exchanged
    return once.union(again).select(*names)
