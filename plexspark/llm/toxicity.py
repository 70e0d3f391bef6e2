"""Toxicity (operator 11): noisy-channel deobfuscation by Viterbi, then a score of the restored text.

What a writer disguises, a channel has distorted: letters became digits or
signs, were repeated, or were set apart by blanks and punctuation. Every word
that may be so is a lattice: each run of equal characters offers what it may
have been, at a price in bits, and a language model of characters prices what
comes out. The Viterbi algorithm finds the cheapest path, over states of the
last two characters. Words of letters without long or many repetitions stand
for themselves and need no search.

The language model holds trigrams of the 26 letters, any other letter, and the
end of a word, counted over the plain words of all documents. The classifier is
a logistic regression over beginnings of restored words and whole ones: those
that tell labels apart best in a sample of at most ``SAMPLE`` labelled documents
(drawn by a hash of their ids), on which it is fitted as well. Both models have
bounded sizes; documents are scored where they are, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexspark.llm import shared, words

#: Labelled documents that the classifier is fitted on at most, and how many beginnings of words it looks at.
SAMPLE, FEATURES = 8000, 2048
#: Bytes of the beginnings of words.
HEADS = range(4, 9)
#: Symbols of the language model: the end of a word, a to z, any other letter.
SYMBOLS = 28
# Which letters signs and digits stand for.
SIGNS = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c"}
#: Prices in bits: a sign for a letter, a letter once for twice, a letter once or twice for more.
SWAP, HALVED, FEWER = 2.0, 7.0, 1.0
#: A sign that means nothing; a run of them at the end; a digit that stays one.
NOISE, RUN, DIGIT = 12.0, 3.0, 7.0
#: Punctuation or a blank left out or kept, between longer pieces and between single characters.
GLUED, APART, JOINED, KEPT = 2.0, 2.0, 0.0, 5.0
#: Words whose restored form a task remembers, and their length at most.
KNOWN, SHORT = 1 << 16, 64
U = np.uint64


def _table(characters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters.encode())] = True
    return out


LETTER = _table("abcdefghijklmnopqrstuvwxyz")
LETTER[0x80:] = True
LEAD, TRAIL = _table("\"'([{<*#%&-_"), _table("\"')]}>*#%&-_.,;:?!")
SIGN = _table("".join(SIGNS))
CODE = np.zeros(256, np.int64)
CODE[list(b"abcdefghijklmnopqrstuvwxyz")] = np.arange(1, 27)
CODE[0xC0:] = 27


class Sorted:
    """The words of a pass: plain ones, doubtful ones, and groups of single characters."""

    def __init__(self, buf: np.ndarray, at: np.ndarray):
        self.buf = words.LOWER[buf]
        self.words = w = words.words_of(self.buf, at)
        solid, ahead = np.flatnonzero(~TRAIL[self.buf]), np.flatnonzero(~LEAD[self.buf])
        last = np.searchsorted(solid, w.end) - 1
        self.end = np.maximum(np.where(last >= 0, solid[np.maximum(last, 0)] + 1, 0), w.start) if len(solid) else w.start
        first = np.searchsorted(ahead, w.start)
        self.start = np.minimum(ahead[np.minimum(first, len(ahead) - 1)], self.end) if len(ahead) else self.end
        self.start = np.where(first < len(ahead), self.start, self.end)
        letter = LETTER[self.buf]
        again = np.zeros(len(self.buf), bool)
        again[2:] = letter[2:] & (self.buf[2:] == self.buf[1:-1]) & (self.buf[1:-1] == self.buf[:-2])
        inside = np.stack([self.start, self.end], axis=1).ravel()
        letters = words.row_sums(letter, inside)[::2]
        length = self.end - self.start
        repeats = words.row_sums(again, np.stack([np.minimum(self.start + 2, self.end), self.end], axis=1).ravel())[::2]
        twice = np.zeros(len(self.buf), bool)
        twice[1:] = letter[1:] & (self.buf[1:] == self.buf[:-1])
        doubles = words.row_sums(twice, np.stack([np.minimum(self.start + 1, self.end), self.end], axis=1).ravel())[::2]
        self.plain = (letters == length) & (length > 0) & (repeats == 0) & (doubles < 3)
        doubtful = (letters > 0) & ~self.plain
        single = length == 1
        one = self.buf[np.minimum(self.start, max(len(self.buf) - 1, 0))] if len(self.buf) else np.zeros(len(length), np.uint8)
        single &= (LETTER[one] & (one < 0x80)) | SIGN[one]
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)) != 0)
        self.groups: list[tuple[int, int]] = []
        for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            cuts = [a, *(np.flatnonzero(np.diff(w.doc[a:z])) + a + 1).tolist(), z]
            self.groups += [(x, y) for x, y in zip(cuts[:-1], cuts[1:], strict=True) if y - x >= 3 and letter[self.start[x:y]].sum() >= 2]
        for a, z in self.groups:
            self.plain[a:z] = doubtful[a:z] = False
        self.doubtful = np.flatnonzero(doubtful)

    def counts(self) -> np.ndarray:
        """Trigrams of the plain words; the first character of a word follows two ends."""
        inside = np.zeros(len(self.buf) + 1, np.int64)
        np.add.at(inside, self.start[self.plain], 1)
        np.add.at(inside, self.end[self.plain], -1)
        code = np.where(np.cumsum(inside[:-1]) > 0, CODE[self.buf], 0)
        code = code[(code > 0) | (self.buf < 0x80) | (self.buf >= 0xC0)]  # one symbol a character
        code = np.r_[0, code, 0]
        code = np.r_[0, code[np.r_[True, (code[1:] > 0) | (code[:-1] > 0)]]]
        before = np.where(code[1:-1] > 0, code[:-2], 0)
        return np.bincount((before * SYMBOLS + code[1:-1]) * SYMBOLS + code[2:], minlength=SYMBOLS**3)


def prices(counts: np.ndarray) -> list[float]:
    """Bits of each character after two others, interpolated with shorter histories."""
    c = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
    share = lambda x: x / np.maximum(x.sum(axis=-1, keepdims=True), 1)
    p = 0.8 * share(c) + 0.15 * share(c.sum(axis=0)) + 0.04 * share(c.sum(axis=(0, 1))) + 0.01 / SYMBOLS
    return (-np.log2(p)).ravel().tolist()


def _symbols(text: str) -> tuple[int, ...]:
    return tuple(ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else 27 for c in text)


def lattice(word: str) -> list[list[tuple[tuple[int, ...], str, float]]]:
    """What each run of equal characters may stand for: (symbols, characters, price)."""
    out, i = [], 0
    single = all(len(x) == 1 for x in "".join(c if c.isalnum() or c in SIGNS else " " for c in word).split())
    while i < len(word):
        c, j = word[i], i
        while j < len(word) and word[j] == c:
            j += 1
        run, i = j - i, j
        if c in SIGNS:
            ways = [(m * k, SWAP + (HALVED * (k == 1) if run == 2 else FEWER * k * (run > 2))) for m in SIGNS[c] for k in ((1,) if run == 1 else (1, 2))]
            if c.isdigit():
                ways.append((c * run, DIGIT))
            else:
                ways += [("", RUN if run > 1 and i == len(word) else NOISE), (" ", NOISE)]
        elif c.isalpha():
            ways = [(c, 0.0)] if run == 1 else [(c * 2, 0.0), (c, HALVED)] if run == 2 else [(c, FEWER), (c * 2, 2 * FEWER)]
        else:
            ways = [("", JOINED), (" ", KEPT)] if single else [("", GLUED), (" ", APART)]
        out.append([(_symbols(t), t, p) for t, p in ways])
    return out


def spaced(characters: str) -> list[list[tuple[tuple[int, ...], str, float]]]:
    """The lattice of characters that were set apart by blanks."""
    out = []
    for n, c in enumerate(characters):
        if n:
            out.append([((), "", JOINED), ((0,), " ", KEPT)])
        out += lattice(c)
    return out


def decode(units: list[list[tuple[tuple[int, ...], str, float]]], price: list[float]) -> str:
    """The cheapest path through a lattice (Viterbi)."""
    layer: dict[int, tuple[float, tuple | None]] = {0: (0.0, None)}  # by the last two symbols
    for ways in units:
        new: dict[int, tuple[float, tuple | None]] = {}
        for state, (cost, path) in layer.items():
            for symbols, text, more in ways:
                total, at = cost + more, state
                for s in symbols:
                    if s or at:
                        total += price[at * SYMBOLS + s]
                        at = at % SYMBOLS * SYMBOLS + s if s else 0
                if at not in new or total < new[at][0]:
                    new[at] = (total, (path, text) if text else path)
        layer = new
    _, path = min(((cost + (price[at * SYMBOLS] if at else 0), path) for at, (cost, path) in layer.items()), key=lambda x: x[0])
    out = []
    while path:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


class Restorer:
    """Restores the words of passes, and remembers short ones."""

    def __init__(self, price: list[float]):
        self.price, self.known = price, {}

    def word(self, word: str, apart: bool = False) -> str:
        key = (word, apart)
        if key not in self.known:
            found = decode(spaced(word) if apart else lattice(word), self.price)
            if len(word) > SHORT:
                return found
            if len(self.known) >= KNOWN:
                self.known.clear()
            self.known[key] = found
        return self.known[key]

    def changes(self, s: Sorted) -> list[tuple[int, int, str]]:
        """(first word, end, restored) of the words of a pass that are not plain."""
        raw, start, end = s.buf.tobytes(), s.start.tolist(), s.end.tolist()
        read = lambda a, z: raw[a:z].decode("utf-8", "replace")
        out = [(i, i + 1, self.word(read(start[i], end[i]))) for i in s.doubtful.tolist()]
        out += [(a, z, self.word("".join(read(start[i], end[i]) for i in range(a, z)), apart=True)) for a, z in s.groups]
        return sorted(out)

    def features(self, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(feature, row) of the words of a pass, restored: hashes of their beginnings and of the whole; repeats stay."""
        s = Sorted(buf, at)
        keys, rows = [], []
        changed = [(int(s.words.doc[a]), x.encode()) for a, _, t in self.changes(s) for x in t.split()]
        side = np.frombuffer(b"".join(x for _, x in changed), np.uint8)
        to = np.cumsum([0, *(len(x) for _, x in changed)])
        for text, start, end, row in ((s.buf, s.start[s.plain], s.end[s.plain], s.words.doc[s.plain]), (side, to[:-1], to[1:], np.array([r for r, _ in changed], np.int64))):
            if not len(start):
                continue
            padded = np.concatenate([text, np.zeros(8, np.uint8)])
            eight = np.lib.stride_tricks.as_strided(padded, (len(text) + 1, 8), (1, 1))[start].view("<u8")[:, 0]
            size = end - start
            for n in HEADS:
                on = np.flatnonzero(size >= n)
                keys.append(words.mix(eight[on] & U((1 << 8 * n) - 1 if n < 8 else (1 << 64) - 1), 60 + n))
                rows.append(row[on])
            keys.append(words.span_hashes(text, start, end, seed=30))
            rows.append(row)
        return (np.concatenate(keys), np.concatenate(rows)) if keys else (np.empty(0, U), np.empty(0, np.int64))


def language_model(docs: DataFrame, text: str = "text") -> list[float]:
    """Prices of characters after two others, from the plain words of all texts; a table of fixed size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, buf, at in shared.passes(batch, "text"):
                total += Sorted(buf, at).counts()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], ["code", "n"])

    seen = docs.select(F.col(text).alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3)
    for r in seen.collect():  # SYMBOLS ** 3 rows at most
        counts[r.code] = r.n
    return prices(counts)


def restore(docs: DataFrame, price: list[float], text: str = "text", into: str = "restored") -> DataFrame:
    """``docs`` with the restored text: words in lower case without punctuation around them, joined by one space.

    A null, empty or blank text gives an empty one. A column ``into`` is replaced.
    """
    own = docs.drop(into)
    names, known = own.columns, docs.sparkSession.sparkContext.broadcast(price)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(known.value)
        for batch in batches:
            for part, buf, at in shared.passes(batch, text):
                s = Sorted(buf, at)
                raw = s.buf.tobytes()
                out: list[list[str]] = [[] for _ in range(part.num_rows)]
                changed, i = {a: (z, t) for a, z, t in restorer.changes(s)}, 0
                while i < len(s.start):
                    end, word = changed.get(i) or (i + 1, raw[s.start[i] : s.end[i]].decode("utf-8", "replace"))
                    out[s.words.doc[i]].append(word)
                    i = end
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([" ".join(x for x in t if x) for t in out], pa.string())], [*names, into])

    return own.mapInArrow(run, f"{schema}, `{into}` string")


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, label) of at most ``SAMPLE`` labelled documents, one row an id, as a table."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label"))
    drawn = shared.cut(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))
    rows = docs.join(F.broadcast(drawn), "doc_id").groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return shared.cut(rows.select("doc_id", "text", "label"))


def _telling(sample: DataFrame, known) -> tuple[np.ndarray, float]:
    """The features that tell the labels apart best (likelihood ratio), sorted; and the share of label 1."""
    total, ones = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < ones < total:
        return np.empty(0, U), ones / total if total else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(known.value)
        for batch in batches:
            for part, buf, at in shared.passes(batch, "text"):
                key, row = restorer.features(buf, at)
                once = np.unique(np.stack([key, row.astype(U)]), axis=1) if len(key) else np.empty((2, 0), U)
                key, where = np.unique(once[0], return_inverse=True)
                label = np.asarray(part.column(1), np.int64)[once[1].astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.bincount(where, minlength=len(key)), pa.int64()), pa.array(np.bincount(where, label, len(key)).astype(np.int64))], ["key", "n", "ones"])

    seen = sample.select("text", "label").mapInArrow(run, "key long, n long, ones long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    n, a = F.col("n"), F.col("ones")
    term = lambda x, whole: F.when(x > 0, x * F.log(x / whole)).otherwise(0.0)
    ratio = term(a, n) + term(n - a, n) + term(ones - a, total - n) + term(total - ones - n + a, total - n)
    best = seen.where("n >= 3").orderBy(F.desc(F.round(ratio, 9)), "key").limit(FEATURES)
    return np.sort(np.array([r.key for r in best.select("key").collect()], np.int64).view(U)), ones / total


def _present(restorer: Restorer, telling: np.ndarray, buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the telling features that each text has, each once."""
    key, row = restorer.features(buf, at)
    if not len(key) or not len(telling):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(1 << 16, bool)
    seen[(telling & U(0xFFFF)).astype(np.int64)] = True
    on = np.flatnonzero(seen[(key & U(0xFFFF)).astype(np.int64)])
    key, row = key[on], row[on]
    place = np.minimum(np.searchsorted(telling, key), len(telling) - 1)
    on = telling[place] == key
    both = np.unique(row[on] * len(telling) + place[on])
    return both // len(telling), both % len(telling)


def regression(rows: list[tuple[list[int], int]], width: int, decay: float = 1e-3, steps: int = 400, lift: float = 0.5) -> np.ndarray:
    """Weights of a logistic regression and its constant, by accelerated gradient descent.

    A row of the rarer label counts as (rows of the other / its own) ** ``lift``
    rows, so that one word that tells is enough.
    """
    x = np.zeros((len(rows), width + 1), np.float32)
    x[:, -1] = 1
    for i, (on, _) in enumerate(rows):
        x[i, on] = 1
    y = np.array([label for _, label in rows], np.float32)
    weights = np.zeros(width + 1, np.float32)
    ones, others = y.sum() + 0.5, len(y) - y.sum() + 0.5
    each = np.where(y > 0, max(others / ones, 1) ** lift, max(ones / others, 1) ** lift).astype(np.float32)
    each /= each.mean()
    weights[-1] = np.log(ones / others)
    vector = np.ones(width + 1, np.float32)
    for _ in range(20):  # the largest curvature, by the power method
        vector = x.T @ (each * (x @ vector))
        size = np.linalg.norm(vector)
        vector /= size
    rate = 1 / (0.25 * size / len(y) + decay)
    hold = np.full(width + 1, decay, np.float32)
    hold[-1] = 0
    ahead, last = weights.copy(), weights
    for step in range(steps):
        slope = x.T @ (each * (1 / (1 + np.exp(-(x @ ahead))) - y)) / len(y) + hold * ahead
        weights = ahead - rate * slope
        ahead, last = weights + step / (step + 3) * (weights - last), weights
    return weights.astype(float)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(doc_id, score, predicted) for each row of ``docs``: how likely its label is 1, learned from ``labels`` (doc_id, label).

    The score depends on the text alone. Null, empty and blank texts have no
    words and the score of such, near the share of label 1. Rows of labels
    without an id or a label, or for no document, teach nothing; of several
    labels of an id the greatest counts, of several texts the least. Without
    labels every score is 0, with labels of one kind their share. Repeated rows
    repeat their result, null ids are passed on, an empty table gives an empty
    one, other columns are dropped.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    context = docs.sparkSession.sparkContext
    known = context.broadcast(language_model(own))
    with shared.scratch():
        sample = _sample(own, labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")))
        telling, share = _telling(sample, known)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer = Restorer(known.value)
            for batch in batches:
                for part, buf, at in shared.passes(batch, "text"):
                    row, on = _present(restorer, telling, buf, at)
                    lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32()), pa.array(on, pa.int64()))
                    yield pa.RecordBatch.from_arrays([lists, part.column(1)], ["present", "label"])

        weights = np.array([])
        if len(telling):
            rows = sample.select("text", "label").mapInArrow(read, "present array<long>, label int").orderBy("label", "present").collect()  # SAMPLE rows at most
            weights = regression([(r.present, r.label) for r in rows], len(telling))
    model = context.broadcast((telling, weights, share))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, (telling, weights, share) = Restorer(known.value), model.value
        for batch in batches:
            for part, buf, at in shared.passes(batch, "text"):
                out = np.full(part.num_rows, share)
                if len(telling):
                    row, on = _present(restorer, telling, buf, at)
                    out = 1 / (1 + np.exp(-(weights[-1] + np.bincount(row, weights[on], part.num_rows))))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return own.mapInArrow(judge, "doc_id long, score double, predicted int").withColumnRenamed("doc_id", doc_id)
