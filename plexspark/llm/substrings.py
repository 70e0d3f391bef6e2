"""Substring dedup (operator 9): suffix automata over reference shards.

The reference is every passage that occurs twice, once: a suffix automaton of
it accepts just what is to be removed. An automaton of the whole corpus would
grow with the corpus, so the passages are found first, in three steps that
exchange hashes only:

1. every text gives the least hash of the 8-word grams in each of its windows;
   a window that occurs twice has a least hash that occurs twice;
2. the windows of those hashes are counted by 128-bit hashes, and each that
   occurs twice is kept at one place;
3. places that follow one another and have one least hash make up a reference
   passage of bounded length.

A least hash owns a shard: its passages and, of every document, the runs of
windows that have it (regions) are sent there, so what is sent grows with the
text that repeats and not with the number of shards. A hash with more passages
than a shard may hold is split by a hash of the window. A shard's automaton
gives for every word of a region the longest passage ending there (matching
statistics); matches of a window's length or more are removed. A shard that many
documents need is copied to as many tasks as they take, so that none is overrun.
Texts with the same words (SHA-256 of them) are looked at once, for all copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexspark.llm import shared, words

#: Words of a gram whose least hash stands for a window.
GRAM = 8
#: Reference words of a shard, about; its automaton takes some 600 bytes for each.
SHARD_WORDS = 75_000
#: Words of documents that one copy of a shard's automaton is asked for, about.
COPY_WORDS = 2_000_000
#: Windows of a passage or region at most; longer runs are cut, with a window's overlap.
RUN = 1024
U = np.uint64


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for each i that has so many."""
    span, out = 1, x
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - span :]) if width > span else out


def least_hashes(each: np.ndarray, w: words.Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts of windows, their least gram hash, hashes of all grams) from the words' hashes."""
    begin = words.window_starts(w, window)
    if not len(begin):
        return begin, np.empty(0, U), np.empty(0, U)
    grams = words.run_hashes(each, GRAM)
    return begin, _sliding_min(grams, window - GRAM + 1)[begin], grams


def _joined(buf: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    return b" ".join([buf[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)])


def _survey(docs: DataFrame, window: int) -> DataFrame:
    """For each (id, hash, text): n_words, the SHA-256 of its words joined by one space, and its least hashes with how often they occur (1, or 2 for more)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, at in shared.passes(batch):
                w = words.words_of(buf, at)
                begin, least, grams = least_hashes(words.span_hashes(buf, w.start, w.end), w, window)
                doc = w.doc[begin]
                change = np.ones(len(begin), bool)
                change[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
                least, doc = least[change], doc[change]
                key = least ^ words.mix(doc, 9)
                _, first = np.unique(key, return_index=True)
                first.sort()
                least, doc, key = least[first], doc[first], key[first]
                inside = w.left()[: len(grams)] >= GRAM
                mine = grams[inside] ^ words.mix(w.doc[: len(grams)][inside], 9)
                again = np.isin(key, mine[words.repeated(mine)])
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32)
                entry = pa.StructArray.from_arrays([pa.array(least.view(np.int64)), pa.array(np.where(again, 2, 1).astype(np.int32))], ["gram", "times"])
                raw = buf.tobytes()
                sha = [hashlib.sha256(_joined(raw, w.start[a:b], w.end[a:b])).digest() for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(w.counts, pa.int64()), pa.array(sha, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), entry)],
                    ["id", "hash", "n_words", "sha", "grams"],
                )

    return docs.mapInArrow(run, "id long, hash long, n_words long, sha binary, grams array<struct<gram:long,times:int>>")


def _asked_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The entries of a list column and the row of each."""
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))


def _windows(texts: DataFrame, window: int) -> DataFrame:
    """(w1, w2, num, at, c) for each window of (num, c, text, asked) whose least hash is asked for; at: its first word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, at in shared.passes(batch):
                w = words.words_of(buf, at)
                each = words.span_hashes(buf, w.start, w.end)
                begin, least, _ = least_hashes(each, w, window)
                asked, row = _asked_rows(part.column(3))
                begin = begin[np.isin(least ^ words.mix(w.doc[begin], 9), asked.view(U) ^ words.mix(row, 9))]
                doc = w.doc[begin]
                both = (each, words.span_hashes(buf, w.start, w.end, 1))
                keys = [pa.array(words.run_hashes(e, window, k)[begin].view(np.int64) if len(begin) else np.empty(0, np.int64)) for k, e in enumerate(both)]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(part.column(0).to_numpy()[doc]), pa.array((begin - w.first[doc]).astype(np.int32)), pa.array(part.column(1).to_numpy()[doc])], ["w1", "w2", "num", "at", "c"])

    return texts.mapInArrow(run, "w1 long, w2 long, num long, at int, c long")


def _cuts(head: np.ndarray) -> np.ndarray:
    """Where runs begin that ``head`` marks the heads of, none longer than RUN."""
    n = np.arange(len(head))
    return np.flatnonzero(head | ((n - np.maximum.accumulate(np.where(head, n, 0))) % RUN == 0))


def _passages(texts: DataFrame, window: int) -> DataFrame:
    """(num, gram, n, passage) of (num, text, starts): runs of the windows that start there and have one least hash, n words long.

    A start is a word and the window's hash, which tells two texts of one num apart.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, at in shared.passes(batch):
                w = words.words_of(buf, at)
                each = words.span_hashes(buf, w.start, w.end)
                begin, least, _ = least_hashes(each, w, window)
                starts = part.column(2).flatten()
                row = np.repeat(np.arange(part.num_rows), part.column(2).value_lengths().to_numpy(zero_copy_only=False))
                asked, hashed = starts.field(0).to_numpy() + w.first[row], starts.field(1).to_numpy().view(U)
                inside = asked + window <= w.first[row + 1]
                asked, hashed = asked[inside], hashed[inside]
                mine = np.searchsorted(begin, np.sort(asked[words.run_hashes(each, window)[asked] == hashed] if len(asked) else asked))
                first, least, doc = begin[mine], least[mine], w.doc[begin[mine]]
                head = np.ones(len(first), bool)  # a step of more than one would let in a window that is not repeated
                head[1:] = (np.diff(first) > 1) | (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
                cuts = _cuts(head)
                lo, hi = first[cuts], first[np.r_[cuts[1:] - 1, len(first) - 1][: len(cuts)]] + window
                raw = buf.tobytes()
                text = [_joined(raw, w.start[a:b], w.end[a:b]) for a, b in zip(lo, hi, strict=True)]
                who = pa.array(part.column(0).to_numpy()[doc[cuts]])
                yield pa.RecordBatch.from_arrays([who, pa.array(least[cuts].view(np.int64)), pa.array(hi - lo, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())], ["num", "gram", "n", "passage"])

    return texts.mapInArrow(run, "num long, gram long, n long, passage string")


def _regions(texts: DataFrame, window: int, shards: int) -> DataFrame:
    """(id, hash, shard, at, n, text) of (id, hash, text, grams, parts): for each of the grams the runs of words whose windows have it, by the shard that owns it (or that part of it)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, at in shared.passes(batch):
                w = words.words_of(buf, at)
                each = words.span_hashes(buf, w.start, w.end)
                begin, least, _ = least_hashes(each, w, window)
                asked, row = _asked_rows(part.column(3))
                parts, _ = _asked_rows(part.column(4))
                wanted = asked.view(U) ^ words.mix(row, 9)
                order = np.argsort(wanted)
                key = least ^ words.mix(w.doc[begin], 9)
                place = np.searchsorted(wanted[order], key)
                hit = np.flatnonzero(wanted[order][np.minimum(place, len(order) - 1)] == key) if len(order) else np.empty(0, np.int64)
                first, split = begin[hit], parts[order][place[hit]].astype(U) if len(hit) else np.empty(0, U)
                owner = words.mix(least[hit], 61)
                if (split > 1).any():
                    many = split > 1
                    owner[many] = words.mix(owner[many] + words.run_hashes(each, window)[first[many]] % split[many], 62)
                order = np.lexsort((first, owner))
                first, owner = first[order], owner[order]
                doc = w.doc[first]
                head = np.ones(len(first), bool)
                head[1:] = (np.diff(first) > window) | (owner[1:] != owner[:-1]) | (doc[1:] != doc[:-1])
                cuts = _cuts(head)
                a, b = first[cuts], first[np.r_[cuts[1:] - 1, len(first) - 1][: len(cuts)]] + window
                raw = buf.tobytes()
                text = [_joined(raw, w.start[x:y], w.end[x:y]) for x, y in zip(a, b, strict=True)]
                who = [pa.array(part.column(i).to_numpy()[doc[cuts]]) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [*who, pa.array((owner[cuts] % U(shards)).astype(np.int32)), pa.array((a - w.first[doc[cuts]]).astype(np.int32)), pa.array(b - a, pa.int64()), pa.array(text, pa.binary()).cast(pa.string())],
                    ["id", "hash", "shard", "at", "n", "text"],
                )

    return texts.mapInArrow(run, "id long, hash long, shard int, at int, n long, text string")


class Automaton:
    """Suffix automaton over words; passages are kept apart by marks that no text has."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.last, self.marks = 0, 0

    def add(self, passage: list[bytes]) -> None:
        ids = self.words
        for x in passage:
            self._extend(ids.setdefault(x, len(ids)))
        self.marks -= 1
        self._extend(self.marks)

    def _extend(self, c: int) -> None:
        nxt, link, size = self.next, self.link, self.size
        new, p = len(nxt), self.last
        nxt.append({})
        size.append(size[p] + 1)
        link.append(0)
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = clone
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
        self.last = new

    def matches(self, text: list[bytes], least: int) -> list[tuple[int, int]]:
        """Maximal spans [start, end) of words that lie in matches of ``least`` words or more."""
        nxt, link, size, ids = self.next, self.link, self.size, self.words
        state = n = 0
        out: list[tuple[int, int]] = []
        for i, x in enumerate(text):
            c = ids.get(x)
            if c is None:
                state = n = 0
                continue
            while state and c not in nxt[state]:
                state = link[state]
                n = size[state]
            state = nxt[state].get(c, 0)
            n = n + 1 if state else 0
            if n >= least:
                if out and out[-1][1] >= i - n + 1:
                    out[-1] = (min(out[-1][0], i - n + 1), i + 1)
                else:
                    out.append((i - n + 1, i + 1))
        return out


def _stream(rows: DataFrame, window: int) -> DataFrame:
    """(id, hash, start, end) of matches; of the rows (shard, copy, kind, id, hash, at, text) of a copy the passages (kind 0) come first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, machine = None, Automaton()
        for batch in batches:
            found: list[tuple[int, int, int, int]] = []
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for shard, copy, kind, i, h, at, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if (shard, copy) != here:
                        here, machine = (shard, copy), Automaton()
                    if kind == 0:
                        machine.add(text.encode().split())
                    else:
                        found += [(i, h, at + a, at + b) for a, b in machine.matches(text.encode().split(), window)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["id", "hash", "start", "end"])

    return rows.mapInArrow(run, "id long, hash long, start int, end int")


def _settle(texts: DataFrame) -> DataFrame:
    """(id, hash, spans, n_removed, left) of (id, hash, text, found): spans joined, and a hash of the words that stay."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, gone, sha = [], [], []
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for text, found in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    w, own, left, at = text.encode().split(), [], [], 0
                    for s in sorted((x["start"], x["end"]) for x in found):
                        if own and s[0] <= own[-1][1]:
                            own[-1] = (own[-1][0], max(own[-1][1], s[1]))
                        else:
                            own.append(s)
                    for a, b in own:
                        left += w[at:a]
                        at = b
                    left += w[at:]
                    spans.append([{"start": a, "end": b} for a, b in own])
                    gone.append(len(w) - len(left))
                    sha.append(hashlib.sha256(b" ".join(left)).digest())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, kind), pa.array(gone, pa.int64()), pa.array(sha, pa.binary())], ["id", "hash", "spans", "n_removed", "left"])

    return texts.mapInArrow(run, "id long, hash long, spans array<struct<start:int,end:int>>, n_removed long, left binary")


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 35) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for each row of ``docs``.

    spans are the words, as [start, end), that lie in a window of ``window``
    words which starts anywhere else too, in the same text or in another row;
    kept_sha256 is of the other words, joined by one space. A null or empty text
    has no words and loses none; texts shorter than a window lose none. A null
    doc_id is an id like any other; a row that repeats another one's words loses
    all of them (from a window's length on). An empty table gives an empty one; ids
    are cast to long. Other columns are dropped.
    """
    if window < GRAM:
        raise ValueError(f"a window needs {GRAM} words at least")
    base = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    rows = shared.cut(_survey(base, window))

    # Texts of the same words are one node, looked at once; each of its windows counts as often as it has copies.
    long = rows.where(F.col("n_words") >= window)
    known = F.coalesce("id", F.lit(0)).alias("id")  # texts of one hash are one text, whatever their ids
    nodes = long.groupBy("sha").agg(F.count("*").alias("c"), F.min(F.struct(known, "hash")).alias("node"), F.first("grams").alias("grams"))
    nodes = shared.cut(nodes.select("sha", "c", "node.id", "node.hash", "grams"))
    # num stands for a node where a clash of two would only cost time.
    num = F.xxhash64("id", "hash").alias("num")
    grams = nodes.select(num, "c", F.explode("grams").alias("g")).select("num", "c", "g.gram", "g.times")
    twice = shared.cut(grams.groupBy("gram").agg(F.sum(F.greatest("times", "c")).alias("t")).where("t > 1"))  # as many rows at most
    asked = shared.cut(shared.join_counted(grams, twice, "gram", "t").select("num", "gram", "c"))
    often = twice.where(F.col("t") > (twice.agg(F.sum("t")).first()[0] or 0) // shared.HOT)  # so many rows at most
    lists = asked.groupBy("num").agg(F.max("c").alias("c"), F.collect_list("gram").alias("asked"))
    texts = lists.join(base.select(known, "hash", "text").select(num, "id", "hash", "text"), "num").dropDuplicates(["num", "id", "hash"])
    texts = shared.cut(texts.select("num", "c", "id", "hash", "text", "asked"))

    found = _windows(texts.select("num", "c", "text", "asked"), window).groupBy("w1", "w2").agg(F.sum("c").alias("c"), F.min("num").alias("num"), F.min_by("at", "num").alias("at")).where("c > 1")
    starts = found.groupBy("num").agg(F.collect_list(F.struct("at", "w1")).alias("starts"))
    passages = shared.cut(_passages(texts.join(starts, "num").select("num", "text", "starts"), window))

    total = passages.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_WORDS))
    owned = shared.cut(passages.groupBy("gram").agg(F.ceil(F.sum("n") / SHARD_WORDS).cast("int").alias("parts")))
    of = shared.cut(owned.join(F.broadcast(often), "gram", "left").withColumn("t", F.coalesce("t", F.lit(0))))
    routes = shared.join_counted(asked, of, "gram", "t").groupBy("num").agg(F.collect_list(F.struct("gram", "parts")).alias("to"))
    routes = texts.join(routes, "num").select("id", "hash", "text", F.col("to.gram").alias("grams"), F.col("to.parts").alias("parts"))
    regions = shared.cut(_regions(routes, window, shards))
    split = passages.join(owned, "gram").select(F.col("num").alias("id"), F.col("num").alias("hash"), F.col("passage").alias("text"), F.array("gram").alias("grams"), F.array("parts").alias("parts"))
    load = shared.cut(regions.groupBy("shard").agg(F.ceil(F.sum("n") / COPY_WORDS).cast("int").alias("copies")))
    ask = regions.join(load, "shard").select("shard", F.pmod(F.xxhash64("hash", "id"), F.col("copies")).cast("int").alias("copy"), F.lit(1).alias("kind"), "id", "hash", "at", "text")
    tell = _regions(split, window, shards).join(load, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.lit(0).alias("kind"), "id", "hash", "at", "text")
    tasks = max(1, load.agg(F.sum("copies")).first()[0] or 1)
    streamed = tell.union(ask).repartition(tasks, "shard", "copy").sortWithinPartitions("shard", "copy", "kind")
    spans = shared.cut(_stream(streamed, window))
    shared.drop(twice, asked, passages, owned, of, regions, load)

    gathered = spans.groupBy("id", "hash").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    settled = _settle(texts.join(gathered, ["id", "hash"]).select("id", "hash", "text", "found"))
    settled = shared.cut(nodes.select("sha", "id", "hash").join(settled, ["id", "hash"]).select("sha", "spans", "n_removed", "left"))
    shared.drop(nodes, texts, spans)

    empty = F.array().cast("array<struct<start:int,end:int>>")
    out = rows.select("id", "n_words", "sha").join(settled, "sha", "left")
    return out.select(
        F.col("id").alias(doc_id), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.lower(F.hex(F.coalesce("left", "sha"))).alias("kept_sha256"), F.coalesce("spans", empty).alias("spans"),
    )
