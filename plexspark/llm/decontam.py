"""Benchmark decontamination (operator 2): CGK embedding, bit sampling over windows, exact edit distance.

Words are A-Z lower-cased. The CGK embedding walks through a text: at each step
it puts out where it stands and, by a random bit of that word and step, stays or
goes on. Walks through two similar texts fall into step again after an edit, so
a small edit distance becomes a small Hamming distance of what is put out.

``WALKS`` random walks go through an item, about as long as it is, and each is
sampled ``SAMPLES`` times: one coordinate of its first half and one of its
second, a coordinate being the pair of words the walk stands on. Items get into
tables by these keys. In documents the same walks start at every word from which
a window as long as an item could hold one, and look their samples up. As both
halves must agree, a phrase that many items begin with makes no candidate. An
item is embedded from three or four places on (its start, and beyond as many
words as it may have edits), as a block of edits puts walks out of step. With
a fifth of the words edited, one sample agrees in 2 (a block in the middle is
gone) to 80 % of cases, so that of all samples one agrees nearly always; tests
measure the recall by place and kind of edit and length.

Where a window can hold an item is told by counting: k edits spoil at most 2 k
of the n - 1 pairs of neighbours in an item of n words, so the others must be
among the pairs of the window. Items of fewer than ``LEAST`` words are too short
for sampling: of k + 1 parts of such an item k edits leave one whole, and these
parts are looked for as they are.

Candidates need enough of the item's words nearby, are confirmed by edit
distance in words (bit-parallel dynamic programming), then measured in the whole
document. These steps lose no leak.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexspark.llm import shared, words

#: Walks through an item, samples of each, and the words an item needs for them.
WALKS, SAMPLES, LEAST = 16, 4, 8
#: Words of an item whose end is embedded as well, for a block of edits in its middle.
TAIL = 40
#: Lengths of items that differ by less than this factor are sampled at the same steps.
CLASS = 1.25
#: Windows that walk at once.
STARTS = 1024
#: Items and characters of them that one pass over the documents looks for; more items take more passes.
BLOCK_ITEMS, BLOCK_CHARS = 50_000, 16_000_000
#: Items whose words a task keeps at hand.
SPLIT = 5_000
U = np.uint64


def pairs(hashes: np.ndarray) -> np.ndarray:
    """Each word with its successor, hashed; the last one is alone."""
    out = words.mix(hashes, 39)
    out[:-1] = words.mix(out[:-1] ^ hashes[1:], 38)
    return out


def parts(n: int, edits: float) -> list[tuple[int, int]]:
    """(first word, end) of the parts of an item of ``n`` words, of which as many edits as it may have leave one whole."""
    k = int(edits * n) + 1
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def shifts(n: int, edits: float) -> list[int]:
    """Words of an item from which walks start."""
    k = min(int(edits * n), n // 2)
    return sorted({0, min(k + 1, n // 2), n // 3 + 1, *([(n + k) // 2 + 1] if n >= TAIL else [])})


def sampled(n: int, shift: int) -> np.ndarray:
    """(sample, walk, half): the steps whose coordinates make a key, for items of n words or some more, from ``shift`` on."""
    steps = max(2, int(1.6 * (n - shift)))
    half = steps // 2
    rng = np.random.default_rng([n, shift])
    return np.stack([rng.integers(0, half, (SAMPLES, WALKS)), rng.integers(half, steps, (SAMPLES, WALKS))], axis=2)


def walk(hashes: np.ndarray, at: np.ndarray, last: np.ndarray, steps: int) -> np.ndarray:
    """(step, walk, start): where each walk from each of ``at`` stands; none leaves ``last``."""
    out = np.empty((steps, WALKS, len(at)), np.int32)
    at = np.broadcast_to(at, (WALKS, len(at)))
    row = np.arange(WALKS)[:, None]
    for s in range(steps):
        out[s] = at
        if s % 64 == 0:
            bits = np.stack([words.mix(hashes, 80 + WALKS * (s // 64) + w) for w in range(WALKS)])
        at = np.minimum(at + ((bits[row, at] >> U(s % 64)).astype(np.int64) & 1), last)
    return out


def keys(pair: np.ndarray, stands: np.ndarray, steps: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all samples (sample, walk, start) of walks, and where each stands at its second coordinate."""
    w = np.arange(WALKS)
    near, far = stands[steps[:, :, 0], w], stands[steps[:, :, 1], w]
    name = words.mix(np.arange(SAMPLES * WALKS), salt).reshape(SAMPLES, WALKS, 1)
    return words.mix(words.mix(pair[near] ^ name, 36) ^ pair[far], 37), far


class Filter:
    """A bitmap of hashes; some others pass too."""

    def __init__(self, hashes: np.ndarray):
        self.shift = U(64 - max(12, min(27, int(8 * len(hashes)).bit_length())))
        self.bits = np.zeros(1 << int(U(64) - self.shift), bool)
        self.bits[(hashes >> self.shift).astype(np.int64)] = True

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[(hashes >> self.shift).astype(np.int64)]


class Table:
    """Items, and the words of them at which a key was taken, by the key."""

    def __init__(self, keys: np.ndarray, item: np.ndarray, offset: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.item, self.offset = item[order], offset[order]
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.filter = Filter(self.keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the keys are here, and the first and number of the entries of each."""
        some = np.flatnonzero(self.filter.passes(keys))
        at = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
        same = self.keys[at] == keys[some]
        return some[same], self.first[at[same]], self.count[at[same]]


class Index:
    """Tables over a bounded block of items."""

    def __init__(self, items: list[tuple[str, str]], edits: float):
        self.edits = edits
        texts = [t.encode() for _, t in items]
        at = np.cumsum([0, *map(len, texts)])
        buf = words.LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        w = words.words_of(buf, at)
        self.items = [(i, t.lower()) for (i, _), t in zip(items, texts, strict=True)]
        self.split: dict[int, tuple[list[bytes], frozenset]] = {}
        hashes, sizes = words.span_hashes(buf, w.start, w.end), w.counts
        self.short: dict[int, Table] = {}
        cut = np.array([(n, a, b - a) for n in np.flatnonzero((sizes > 0) & (sizes < LEAST)).tolist() for a, b in parts(int(sizes[n]), edits)], np.int64).reshape(-1, 3)
        for m in np.unique(cut[:, 2]).tolist():
            item, offset, _ = cut[cut[:, 2] == m].T
            key = words.run_hashes(hashes, m)[w.first[item] + offset]
            self.short[m] = Table(key, item, offset)
        pair = pairs(hashes)
        long = sizes[w.doc] >= LEAST
        long[:-1] &= w.doc[1:] == w.doc[:-1]
        self.classes: list[tuple[int, int, Filter, Table]] = []  # the fewest and most words of the items, and their pairs
        low = LEAST
        while low <= sizes.max(initial=0):
            high = max(low, int(low * CLASS))
            own = np.flatnonzero((sizes >= low) & (sizes <= high))
            if len(own):
                inside = long & (sizes >= low)[w.doc] & (sizes <= high)[w.doc]
                self.classes.append((low, int(sizes[own].max()), Filter(pair[inside]), self._table(hashes, pair, w, own, low)))
            low = high + 1

    def _table(self, hashes: np.ndarray, pair: np.ndarray, w: words.Words, own: np.ndarray, low: int) -> Table:
        out = []
        for j, shift in enumerate(shifts(low, self.edits)):
            steps = sampled(low, shift)
            for lo in range(0, len(own), STARTS):
                item = own[lo : lo + STARTS]
                first, last = w.first[item], w.first[item + 1] - 1
                base = int(first[0])
                there = slice(base, int(last[-1]) + 1)
                stands = walk(hashes[there], first + shift - base, last - base, int(steps.max()) + 1)
                key, far = keys(pair[there], stands, steps, 50 + j)
                fine = np.broadcast_to(far < last - base, key.shape)  # the last word has no successor in the item
                out.append((key[fine], np.broadcast_to(item, key.shape)[fine], (far - (first - base))[fine]))
        return Table(*map(np.concatenate, zip(*out, strict=True)))

    def candidates(self, hashes: np.ndarray, first: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """(row, number of an item, words of the row at which the item would start, in order), row by row."""
        n, hits = len(hashes), []
        if not n:
            return
        for m, table in self.short.items():
            start, a, count = table.find(words.run_hashes(hashes, m))
            inside = doc[start] == doc[np.minimum(start + m, n) - 1]
            hits.append((start[inside], table, a[inside], count[inside]))
        if self.classes:
            pair = pairs(hashes)
            for low, high, among, table in self.classes:
                k = int(self.edits * high)
                total = np.zeros(n + high + k + 1, np.int32)
                np.cumsum(among.passes(pair), out=total[1 : n + 1])
                total[n + 1 :] = total[n]
                need = min(m - 1 - 2 * int(self.edits * m) for m in range(low, high + 1))
                begin = np.flatnonzero(total[high + k : n + high + k] - total[:n] >= need)
                reach = max(shifts(low, self.edits)) + 1 + k  # walks start at a shifted place of the item, and edits move it
                begin = np.flatnonzero(words.covered(begin, reach, n + reach)[:n]) if len(begin) else begin
                for lo in range(0, len(begin), STARTS):
                    hits += self._walked(hashes, pair, first, doc, begin[lo : lo + STARTS], low, table)
        if not sum(len(h[0]) for h in hits):
            return
        where = np.concatenate([h[0] for h in hits])
        which = np.concatenate([np.full(len(h[0]), i) for i, h in enumerate(hits)])
        a, count = np.concatenate([h[2] for h in hits]), np.concatenate([h[3] for h in hits])
        order = np.argsort(doc[where], kind="stable")
        where, which, a, count = where[order], which[order], a[order], count[order]
        edges = np.flatnonzero(np.diff(doc[where], prepend=-1, append=-1))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # entries are listed for one row at a time
            row = int(doc[where[lo]])
            spans = [(hits[t][1], slice(x, x + c)) for t, x, c in zip(which[lo:hi].tolist(), a[lo:hi].tolist(), count[lo:hi].tolist(), strict=True)]
            item = np.concatenate([t.item[s] for t, s in spans])
            begins = np.repeat(where[lo:hi] - first[row], count[lo:hi]) - np.concatenate([t.offset[s] for t, s in spans])
            order = np.lexsort((begins, item))
            item, begins = item[order], begins[order]
            keep = np.flatnonzero((np.diff(item, prepend=-1) != 0) | (np.diff(begins, prepend=0) != 0))
            item, begins = item[keep], begins[keep]
            groups = np.flatnonzero(np.diff(item, prepend=-1, append=-1))
            for x, y in zip(groups[:-1].tolist(), groups[1:].tolist(), strict=True):
                yield row, int(item[x]), begins[x:y].tolist()

    def _walked(self, hashes: np.ndarray, pair: np.ndarray, first: np.ndarray, doc: np.ndarray, start: np.ndarray, low: int, table: Table) -> list:
        """What walks from ``start`` on find."""
        plans = [sampled(low, shift) for shift in shifts(low, self.edits)]
        steps = max(int(p.max()) for p in plans) + 1
        last = first[doc[start] + 1] - 1
        # Only the words that walks can reach, each once.
        near = np.flatnonzero(words.covered(start, steps, len(hashes) + steps)[: len(hashes)])
        stands = walk(hashes[near], np.searchsorted(near, start), np.searchsorted(near, np.minimum(last, start + steps - 1)), steps)
        out = []
        for j, plan in enumerate(plans):
            key, far = keys(pair[near], stands, plan, 50 + j)
            on, a, count = table.find(key.ravel())
            out.append((near[far.ravel()[on]], table, a, count))
        return out

    def words(self, k: int) -> tuple[list[bytes], frozenset]:
        """An item's words, and the distinct ones; those of the items asked for last are kept."""
        if k not in self.split:
            if len(self.split) >= SPLIT:
                self.split.clear()
            t = self.items[k][1].split()
            self.split[k] = t, frozenset(t)
        return self.split[k]

    def likely(self, k: int, text: list[bytes], start: int, edits: int) -> bool:
        """Whether enough of an item's words are where a leak from about ``start`` on would have them; an edit takes at most one."""
        item, distinct = self.words(k)
        near = text[max(0, start - edits) : max(0, start + len(item) + edits)]
        return len(distinct.intersection(near)) >= len(distinct) - edits


def edit_distance(item: list[bytes], text: list[bytes]) -> tuple[int, int]:
    """Least number of word edits between the item and any run of words of the text, and where the first such run ends."""
    n = len(item)
    where: dict[bytes, int] = {}
    for i, x in enumerate(item):
        where[x] = where.get(x, 0) | 1 << i
    top, ones = 1 << (n - 1), (1 << n) - 1
    plus, minus, score = ones, 0, n
    best, end = n, 0
    for j, x in enumerate(text):
        eq = where.get(x, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up, down = minus | (ones & ~(diagonal | plus)), plus & diagonal
        score += bool(up & top) - bool(down & top)
        up, down = (up << 1) & ones, (down << 1) & ones
        plus, minus = down | (ones & ~((eq | minus) | up)), up & (eq | minus)
        if score < best:
            best, end = score, j + 1
    return best, end


def near(item: list[bytes], text: list[bytes], starts: list[int], edits: float) -> bool:
    """Whether the item leaks from about one of the starts on; windows that overlap are looked at once, as a whole."""
    k = int(edits * len(item))
    lo = hi = 0
    for b in [*sorted(starts), None]:
        if b is None or b - k > hi:
            if lo < hi and edit_distance(item, text[max(0, lo) : hi])[0] <= k:
                return True
            if b is None:
                break
            lo = b - k
        hi = b + len(item) + k  # a leak is longer than its item by its edits at most
    return False


def leaks(docs: DataFrame, items: DataFrame, edits: float = 0.2, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, item_words, distance, end_word) for each document and item it leaks.

    An item leaks if a run of the document's words is at an edit distance of at
    most ``edits`` times the item's words; distance is the least in the
    document, end_word where the first such run ends. What is returned is exact;
    of leaks with as many edits as allowed a few in a hundred may be missed, of
    those with few edits none in practice. Items without words, and
    null or empty texts, match nothing; an empty table on either side gives an
    empty result; null ids are passed on, ids are cast to long; repeated rows
    on either side repeat their results; other columns are dropped.

    Distinct texts of items are looked for in blocks of bounded size, each in one
    pass over the documents without a shuffle, so any number of them can be
    given; the items of each text are joined to what is found. ``edits``
    is less than 1, else no word of an item need be in a document.
    """
    if not 0 <= edits < 1:
        raise ValueError(f"edits must be in [0, 1), not {edits}")
    items = items.where(F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("t"), F.sha2(F.col(item_text).cast("binary"), 256).alias("key"))
    texts = items.select("key", "t").distinct()
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = _found(own, texts, edits)
    copies = items.groupBy("key", "item_id").agg(F.count("*").cast("int").alias("copies"))
    out = out.join(copies, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    return out.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id), "item_words", "distance", "end_word")


def _found(docs: DataFrame, texts: DataFrame, edits: float) -> DataFrame:
    """What ``_search`` finds of (key, t), block by block."""
    count, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, -(-2 * count // BLOCK_ITEMS), -(-2 * chars // BLOCK_CHARS))
    out = None
    for block in range(blocks):
        part = texts if blocks == 1 else texts.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block)
        found = _search(docs, [(r.key, r.t) for r in part.collect()], edits)
        out = found if out is None else out.union(found)
    return out


def _search(docs: DataFrame, items: list[tuple[str, str]], edits: float) -> DataFrame:
    """(key, item_words, distance, end_word), after the columns of ``docs`` without its last (text), for each document and item (key, text) it leaks."""
    index = docs.sparkSession.sparkContext.broadcast(Index(items, edits))  # of a block of BLOCK_ITEMS items, about
    who = docs.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            for part, buf, at in shared.passes(batch):
                low = words.LOWER[buf]
                w = words.words_of(low, at)
                found = []
                raw = low.tobytes()
                last, text = -1, []
                for row, k, starts in own.candidates(words.span_hashes(low, w.start, w.end), w.first, w.doc):
                    asked, _ = own.words(k)
                    if row != last:
                        last, text = row, raw[at[row] : at[row + 1]].split()
                    starts = [b for b in starts if own.likely(k, text, b, int(edits * len(asked)))]
                    if near(asked, text, starts, edits):
                        distance, end = edit_distance(asked, text)
                        found.append((row, own.items[k][0], len(asked), distance, end))
                rows = part.take(pa.array([f[0] for f in found], pa.int64()))
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], *(pa.array([f[c + 1] for f in found], t) for c, t in enumerate(kinds))], [*who, "key", "item_words", "distance", "end_word"])

    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in who) + ", key string, item_words long, distance long, end_word long")


def remove_leaks(docs: DataFrame, items: DataFrame, edits: float = 0.2, doc_id: str = "doc_id", text: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns.

    Each row is judged by its own text: rows that share a doc_id, null too, go
    or stay one by one. A column ``_leak`` or ``_hash`` of the input is dropped.
    """
    if not 0 <= edits < 1:
        raise ValueError(f"edits must be in [0, 1), not {edits}")
    own = docs.drop("_leak", "_hash")
    names = own.columns
    texts = items.where(F.col(item_text).isNotNull()).select(F.sha2(F.col(item_text).cast("binary"), 256).alias("key"), F.col(item_text).alias("t")).distinct()
    bad = _found(own.select(F.col(doc_id).cast("long").alias("leak"), F.xxhash64(text).alias("hash"), F.col(text).alias("text")), texts, edits)
    bad = bad.select(F.col("leak").alias("_leak"), F.col("hash").alias("_bad")).distinct()
    own = own.withColumn("_hash", F.xxhash64(text))
    return own.join(bad, (F.col("_hash") == F.col("_bad")) & F.col(doc_id).cast("long").eqNullSafe(F.col("_leak")), "left_anti").select(*names)
