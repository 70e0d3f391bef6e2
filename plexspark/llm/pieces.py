"""SentencePiece encoding and decoding (operator 6): seeded merge-dropout.

Text is encoded with a public byte-fallback BPE vocabulary of SentencePiece.
Merges are taken from an agenda in order of score, leftmost first; with a rate
of dropout each candidate merge is skipped for good when a hash, keyed by the
seed, the document and the candidate's place, falls below the rate. A segment
is thus split in various ways in various places, always the same way for one
seed, and every way decodes to the same text.

Spaces become the space mark and one is put in front, as the vocabulary's model
does. No piece has the mark after another character and no piece holds a line
feed, so a text falls into segments (spaces and what follows up to the next
space, or one line feed) that are merged apart. A batch of texts is merged at
once in numpy: each round takes the best candidate of every segment. Segments
of over ``LONG`` characters go through an ordinary heap instead.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StructField, StructType

from plexspark.llm import shared
from plexspark.llm.words import mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Symbols (code points) of a segment beyond which it is merged with a heap.
LONG = 48
#: Code points that one numpy pass merges.
PASS = 1 << 15
U = np.uint64
NONE = np.int32((1 << 31) - 1)


class Vocabulary:
    """Pieces of a model, as arrays that batches are merged with."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.size = n
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte = np.full(256, -1, np.int32)
        plain = {}
        for i, p in enumerate(self.pieces):
            if model.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                plain[p] = i
        if (self.byte < 0).any():
            raise ValueError("the vocabulary has no byte fallback")
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("a piece spans segments")
        self.order = np.empty(n, np.int32)  # merges go by descending score
        self.order[np.argsort([-model.get_score(i) for i in range(n)], kind="stable")] = np.arange(n, dtype=np.int32)
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in plain.items():
            if len(p) == 1 and p != MARK:
                self.char[ord(p)] = i
        self.mark = plain[MARK]
        self.char[32] = self.mark
        pairs = {plain[p[:k]] * n + plain[p[k:]]: i for p, i in plain.items() for k in range(1, len(p)) if p[:k] in plain and p[k:] in plain}
        self.pairs = pairs
        self._hash(pairs)
        self.bytes_of = [p.replace(MARK, " ").encode() for p in self.pieces]
        for b in range(256):
            self.bytes_of[self.byte[b]] = bytes([b])

    def _hash(self, pairs: dict[int, int]) -> None:
        """An open table from pairs of ids to the id they merge into."""
        self.bits = max(4, int(np.ceil(np.log2(len(pairs) + 1))) + 2)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.made = np.full(1 << self.bits, -1, np.int32)
        keys = np.array(sorted(pairs), np.int64)
        made = np.array([pairs[k] for k in keys.tolist()], np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            at, first = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[first]
            self.keys[at], self.made[at] = keys[put], made[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, made, slot = keys[rest], made[rest], (slot[rest] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges into, or -1; ids below 0 never merge."""
        keys = a.astype(np.int64) * self.size + b
        out = np.full(len(keys), -1, np.int32)
        left = np.flatnonzero((a | b) >= 0)
        want = keys[left]
        slot = self._slot(want)
        while len(left):
            there = self.keys[slot]
            hit = np.flatnonzero(there == want)
            out[left[hit]] = self.made[slot[hit]]
            go = np.flatnonzero((there != want) & (there >= 0))
            left, want, slot = left[go], want[go], (slot[go] + 1) & ((1 << self.bits) - 1)
        return out


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def skipped(key: np.ndarray, start: np.ndarray, middle: np.ndarray, end: np.ndarray, rate: float) -> np.ndarray:
    """Whether the merge of [start, middle) and [middle, end) of the text with that key is dropped."""
    place = start.astype(U) * U(0x9E3779B97F4A7C15) + middle.astype(U) * U(0xC2B2AE3D27D4EB4F) + end.astype(U) * U(0x165667B19E3779F9)
    return (mix(place ^ key) >> U(11)).astype(np.float64) < rate * float(1 << 53)


def merge_heap(v: Vocabulary, ids: list[int], at: int, key: int, rate: float) -> list[int]:
    """One segment's pieces through a heap. ``ids``: of its code points, the first of which is number ``at`` of the text."""
    n = len(ids)
    ids, ahead, back, end = list(ids), [*range(1, n), -1], [*range(-1, n - 1)], [*range(1, n + 1)]
    heap: list[tuple[int, int, int, int, int]] = []

    def offer(lefts: list[int]) -> None:
        lefts = [i for i in lefts if i >= 0 and ahead[i] >= 0]
        found = [(i, ahead[i], v.pairs.get(ids[i] * v.size + ids[ahead[i]], -1) if ids[i] >= 0 and ids[ahead[i]] >= 0 else -1) for i in lefts]
        found = [x for x in found if x[2] >= 0]
        if found and rate:
            a, b = np.array([x[0] for x in found]), np.array([x[1] for x in found])
            drop = skipped(np.full(len(a), key, U), a + at, b + at, np.array([end[j] for j in b]) + at, rate)
            found = [x for x, d in zip(found, drop, strict=True) if not d]
        for i, j, made in found:
            heapq.heappush(heap, (int(v.order[made]), i, j, end[j], made))

    offer(list(range(n)))
    while heap:
        _, i, j, e, made = heapq.heappop(heap)
        if ahead[i] != j or end[j] != e or end[i] != j:  # one of the two has been merged since
            continue
        ids[i], end[i], ahead[i] = made, e, ahead[j]
        end[j] = -1
        if ahead[i] >= 0:
            back[ahead[i]] = i
        offer([back[i], i])
    out, i = [], 0
    while i >= 0:
        out.append(i)
        i = ahead[i]
    return [(ids[i], i) for i in out]


def merge_all(v: Vocabulary, ids: np.ndarray, segment: np.ndarray, at: np.ndarray, key: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of many segments: (id, index of the first symbol) in order.

    ``ids`` of all symbols (-1: not in the vocabulary), their ``segment``
    (ascending), their place ``at`` in their text, and the ``key`` of that text.
    """
    n = len(ids)
    where, seg = np.arange(n, dtype=np.int32), segment.astype(np.int32)
    place = at.astype(np.int32)
    ids, end = ids.astype(np.int32), place + np.int32(1)
    done_ids, done_where = [], []

    def offers(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and result of merging symbol i with the next; NONE where there is nothing to merge."""
        order, made = np.full(len(i), NONE), np.full(len(i), -1, np.int32)
        if len(i) and i[-1] == len(ids) - 1:
            i = i[:-1]
        ok = np.flatnonzero(seg[i] == seg[i + 1])
        j = i[ok]
        m = v.merged(ids[j], ids[j + 1])
        hit = np.flatnonzero(m >= 0)
        ok, j, m = ok[hit], j[hit], m[hit]
        if rate and len(j):
            a, b = where[j], where[j + 1]
            stay = np.flatnonzero(~skipped(key[a], place[a], place[b], end[j + 1], rate))
            ok, m = ok[stay], m[stay]
        order[ok], made[ok] = v.order[m], m
        return order, made

    order, made = offers(where)
    while len(ids):
        edge = np.empty(len(ids), bool)
        edge[0] = True
        np.not_equal(seg[1:], seg[:-1], out=edge[1:])
        first = np.flatnonzero(edge)
        best = np.minimum.reduceat(order, first)
        width = np.diff(first, append=len(ids))
        most = np.repeat(best, width)
        open_ = most < NONE
        gone = np.flatnonzero(~open_)
        done_ids.append(ids[gone])  # segments without a candidate leave
        done_where.append(where[gone])
        hits = np.flatnonzero((order == most) & open_)
        lead = np.ones(len(hits), bool)
        np.not_equal(seg[hits[1:]], seg[hits[:-1]], out=lead[1:])
        left = hits[lead]  # the leftmost of the best
        ids[left], end[left] = made[left], end[left + 1]
        stay = open_
        stay[left + 1] = False
        stay = np.flatnonzero(stay)
        new = np.searchsorted(stay, left)
        ids, seg, end, where, order, made = (x.take(stay) for x in (ids, seg, end, where, order, made))
        near = np.zeros(len(ids) + 1, bool)
        near[new] = True
        near[new - 1] = True  # of the first symbol: the spare entry at the end
        near = np.flatnonzero(near[:-1])
        order[near], made[near] = offers(near)
    ids, where = np.concatenate([*done_ids, ids]), np.concatenate([*done_where, where])
    back = np.empty(n, np.int32)
    back.fill(-2)
    back[where] = ids
    origin = np.flatnonzero(back != -2)
    return back[origin], origin


def _pass(v: Vocabulary, texts: list[str], keys: np.ndarray, rate: float) -> list[np.ndarray]:
    points = np.frombuffer("".join([" " + t for t in texts]).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.array([len(t) + 1 for t in texts])
    begin = np.cumsum(sizes) - sizes
    ids = v.char[points]
    ids[points == 0x2581] = -1  # a mark in the text itself is spelt in bytes, so that it comes back
    space, feed = points == 32, points == 10
    opens = feed | (space & ~np.r_[False, space[:-1]]) | np.r_[False, feed[:-1]]
    opens[begin] = True
    segment = np.cumsum(opens) - 1
    text = np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(points)) - begin[text]
    key = keys[text]
    first = np.flatnonzero(opens)
    width = np.diff(np.r_[first, len(points)])
    long = np.flatnonzero(width > LONG)
    short = np.repeat(width <= LONG, width)
    where = np.flatnonzero(short)
    got, origin = merge_all(v, ids[short], segment[short], at[short], key[short], rate)
    got, origin = [got], [where[origin]]
    for s in long:
        lo, hi = first[s], first[s] + width[s]
        pairs = merge_heap(v, ids[lo:hi].tolist(), int(at[lo]), int(key[lo]), rate)
        got.append(np.array([p[0] for p in pairs], np.int32))
        origin.append(np.array([p[1] for p in pairs]) + lo)
    got, origin = np.concatenate(got), np.concatenate(origin)
    order = np.argsort(origin)
    got, origin = got[order], origin[order]
    unknown = np.flatnonzero(got < 0)
    if len(unknown):  # bytes of what the vocabulary lacks
        spelt = [chr(c).encode("utf-8", "surrogatepass") for c in points[origin[unknown]].tolist()]
        count = np.ones(len(got), np.int64)
        count[unknown] = [len(b) for b in spelt]
        out = np.repeat(got, count)
        out[out < 0] = v.byte[np.frombuffer(b"".join(spelt), np.uint8)]
        got, origin = out, np.repeat(origin, count)
    bounds = np.searchsorted(origin, np.r_[begin, len(points)])
    return [got[a:b] if t else got[:0] for a, b, t in zip(bounds[:-1], bounds[1:], texts, strict=True)]


def encode(v: Vocabulary, texts: list[str], keys: np.ndarray, rate: float = 0.0) -> list[np.ndarray]:
    """Ids of each text; ``keys`` (uint64) tell which merges each text drops. An empty text has none."""
    out, lo = [], 0
    while lo < len(texts):
        hi, n = lo, 0
        while hi < len(texts) and (hi == lo or n + len(texts[hi]) < PASS):
            n += len(texts[hi]) + 1
            hi += 1
        out += _pass(v, texts[lo:hi], keys[lo:hi], rate)
        lo = hi
    return out


def decode(v: Vocabulary, ids: list[int]) -> str:
    """The text that was encoded: pieces' bytes joined, without the space in front."""
    return b"".join([v.bytes_of[i] for i in ids])[1:].decode("utf-8", "surrogatepass")


SCHEMA = StructType([StructField("ids", ArrayType(IntegerType(), False)), StructField("round_trip", BooleanType())])


def encode_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str = MODEL, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """``docs`` with a column ``pieces``: a struct of ``ids`` and ``round_trip`` (they decode to the text).

    Each row is encoded alone, without a shuffle. The merges that it drops
    depend on the seed, its doc_id (null counts as one) and the candidate's
    place, so rows that repeat doc_id and text get equal ids. A null text has null
    ids, an empty one none, an empty table stays empty. A column ``pieces`` of the input is replaced. Each
    executor reads the model from ``model``.
    """
    docs = docs.drop("pieces")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model)
        for whole in batches:
            for batch, _, _ in shared.passes(whole, text):
                texts = batch.column(names.index(text)).to_pylist()
                which = [-1 if i is None else hash_of(i) for i in batch.column(names.index(doc_id)).to_pylist()]
                keys = mix(np.array(which, np.int64).astype(U) ^ mix(np.array([seed]), 3)[0], 5)
                ids = encode(v, [t or "" for t in texts], keys, rate)
                same = [None if t is None else decode(v, i.tolist()) == t if t else not len(i) for t, i in zip(texts, ids, strict=True)]
                offsets = pa.array([None if t is None else o for t, o in zip([*texts, ""], np.cumsum([0, *map(len, ids)]).tolist(), strict=True)], pa.int32())
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])], [*names, "pieces"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("pieces", SCHEMA)]))


def hash_of(doc_id: int | str) -> int:
    """A doc_id as a 63-bit number, other types by their text."""
    if isinstance(doc_id, int):
        return doc_id & (1 << 63) - 1
    import xxhash

    return xxhash.xxh64_intdigest(str(doc_id)) >> 1
