"""Periodic runs of words (operator 13), by the algorithm of Kolpakov and Kucherov.

A run is a stretch of words with a smallest period, as long as it gets. A
suffix automaton gives the Lempel-Ziv factors of a text: each is the longest
stretch that also starts earlier, or one new word. A run that touches the start
of a factor and ends in it reaches back at most twice the factor before and the
factor itself, so Main's algorithm finds those of all periods from four arrays
of common extensions, in time linear in these lengths. All other runs lie
strictly inside a factor and are copied from where it occurred before.

Runs of at least ``exponent`` periods and ``least`` words are asked for. Every
stretch of ``grams`` words in such a run occurs twice in its text, so texts are
first cut where one does not (told by hashes, which can only leave too much in);
prose without runs thus costs no automaton.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexspark.llm import shared, words


def automaton(text: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of a text: transitions of each state, and where its words first end."""
    after, link, length, ends = [{}], [-1], [0], [-1]
    last = 0
    for i, c in enumerate(text):
        here, p = len(after), last
        after.append({})
        length.append(i + 1)
        link.append(0)
        ends.append(i)
        while p >= 0 and c not in after[p]:
            after[p][c] = here
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                twin = len(after)
                after.append(after[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                ends.append(ends[q])
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    return after, ends


def factors(text: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, how far back it occurs first) of the Lempel-Ziv factors; occurrences may overlap; a new word is 0 back."""
    after, ends = automaton(text)
    out, b, n = [], 0, len(text)
    while b < n:
        state, i, back = 0, b, 0
        while i < n:
            state = after[state][text[i]]
            if ends[state] >= i:  # the stretch from b to i has not occurred before
                break
            back = i - ends[state]
            i += 1
        i = max(i, b + 1)
        out.append((b, i, back))
        b = i
    return out


def extensions(text: list[int]) -> list[int]:
    """For each place, how many words from it on agree with the start of the text (the Z array)."""
    n = len(text)
    out = [n] * n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, out[i - lo]) if i < hi else 0
        if i + k >= hi:
            while i + k < n and text[k] == text[i + k]:
                k += 1
            lo, hi = i, i + k
        out[i] = k
    return out


def touching(text: list[int], far: int, b: int, f: int, exponent: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of runs that touch place b, start after ``far`` and end by f, found by Main's algorithm.

    A run has a period of words on one side of b at least. A run that ``far``
    or f cuts short is another factor's.
    """
    left, right = text[far:b][::-1], text[b:f]
    ahead = extensions(right)  # of b with b + q
    behind = extensions(left)  # of b - 1 with b - 1 - q, backwards
    both = text[far:f]
    fore = extensions([*right, -1, *both])[len(right) + 1 :]  # of b with any place
    aft = extensions([*left, -1, *both[::-1]])[len(left) + 1 :]  # of b - 1 with any place, backwards
    width = len(both)
    top = width // exponent
    for q in range(1, top + 1):
        for x in (b, b - q):  # the earlier of two places that are q apart and around which the run lies
            if x == b and b + q <= f:
                more = ahead[q] if q < len(right) else 0
                less = aft[width - (b + q - far)]
            elif x != b and x >= far:
                more = fore[x - far] if right else 0
                less = behind[q] if q < len(left) else 0
            else:
                continue
            start, end = x - less, x + q + more
            if end - start >= max(least, exponent * q) and start > far - (far == 0) and start <= b <= end and (end < f or f == len(text) or text[f] != text[f - q]):
                yield start, end, q


def runs(text: list[int], exponent: int = 3, least: int = 24) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period."""
    known: dict[int, dict[int, int]] = {}  # start: end: least period
    starts: list[int] = []

    def add(start: int, end: int, period: int) -> None:
        if start not in known:
            known[start] = {}
            insort(starts, start)
        known[start][end] = min(period, known[start].get(end, period))

    before = 0
    pieces = factors(text)
    for b, f, back in [*pieces, (len(text), len(text), 0)]:
        reach = before + f - b  # a run is shorter than this and its period
        if reach * exponent > (exponent - 1) * least:
            for run in touching(text, max(0, b - before - reach - 1), b, f, exponent, least):
                add(*run)
        at = bisect_right(starts, b - back)
        while back and at < len(starts) and starts[at] < f - back:  # copies join those that are copied
            s = starts[at]
            for e, q in list(known[s].items()):
                if e < f - back:
                    add(s + back, e + back, q)
            at += 1
        before = f - b
    return sorted((s, e - s, q) for s in starts for e, q in known[s].items())


def grams(exponent: int, least: int) -> int:
    """How many words of a run occur twice together wherever they lie in it."""
    return (exponent - 2) * least // exponent + 1


def parts(hashes: np.ndarray, w: words.Words, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(row, first word, end) of the stretches that runs can lie in."""
    size = grams(exponent, least)
    begin = words.window_starts(w, size)
    if not len(begin):
        return []
    keys = words.run_hashes(hashes, size)[begin] ^ words.mix(w.doc[begin], 9)
    twice = begin[words.repeated(keys)]
    if not len(twice):
        return []
    opens = np.flatnonzero((np.diff(twice, prepend=-2) > 1) | (np.diff(w.doc[twice], prepend=-1) != 0))
    first, end = twice[opens], twice[np.r_[opens[1:], len(twice)] - 1] + size
    long = end - first >= least
    return list(zip(w.doc[first[long]].tolist(), first[long].tolist(), end[long].tolist(), strict=True))


RUNS = "struct<n_words:long,runs:array<struct<start:long,length:long,period:long>>,collapsed:string>"


def find_runs(docs: DataFrame, text: str = "text", exponent: int = 3, least: int = 24, into: str = "periodic") -> DataFrame:
    """``docs`` with a struct ``into``: n_words, runs (start, length, period) by start and period, and collapsed.

    Words are runs of characters other than blanks, numbered from 0; collapsed
    is the text without what a run holds after its first period, words joined
    by one space. Null, empty and blank texts have no words and no runs, and are
    collapsed to an empty text. Every row is judged alone, so repeated rows
    repeat their results and a null in another column changes nothing; an empty
    table gives an empty one. A column of the name ``into`` is replaced. A task
    holds one text at a time, and an automaton of its repetitive parts.
    ``exponent`` is 2 or more: with 2 these are all maximal repetitions.
    """
    if exponent < 2 or least < 1:
        raise ValueError("runs need an exponent of 2 or more and at least one word")
    own = docs.drop(into)
    names = own.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, at in shared.passes(batch, text):
                w = words.words_of(buf, at)
                raw, first = buf.tobytes(), w.first.tolist()
                found: list[list[tuple[int, int, int]]] = [[] for _ in range(part.num_rows)]
                for row, a, z in parts(words.span_hashes(buf, w.start, w.end), w, exponent, least):
                    numbers: dict[bytes, int] = {}
                    letters = [numbers.setdefault(x, len(numbers)) for x in raw[w.start[a] : w.end[z - 1]].split()]
                    found[row] += [(a - first[row] + s, n, q) for s, n, q in runs(letters, exponent, least)]
                texts = []
                for row, own in enumerate(found):
                    kept = raw[at[row] : at[row + 1]].split()
                    if own:
                        drop = np.zeros(len(kept), bool)
                        for s, n, q in own:
                            drop[s + q : s + n] = True
                        kept = [x for x, gone in zip(kept, drop.tolist(), strict=True) if not gone]
                    texts.append(b" ".join(kept))
                flat = np.array([r for own in found for r in own], np.int64).reshape(-1, 3)
                listed = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), listed)
                out = pa.StructArray.from_arrays([pa.array(w.counts, pa.int64()), lists, pa.array(texts, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])
                yield pa.RecordBatch.from_arrays([*part.columns, out], [*names, into])

    return own.mapInArrow(run, f"{schema}, `{into}` {RUNS}")


def longest(found: Column) -> Column:
    """The run of the greatest exact length over period; ties go to the smallest start, then period; null without runs."""
    before = lambda x, y: F.when(x["length"] * y["period"] > y["length"] * x["period"], -1).when(x["length"] * y["period"] < y["length"] * x["period"], 1)
    order = lambda x, y: before(x, y).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
    return F.get(F.array_sort(found, order), F.lit(0))


def with_cycles(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` in which a tenth of the texts, drawn by a checksum of their ids, go round in circles from some word on.

    With h the CRC-32 of the decimal id and g = h div 10, a text of n > 0 words
    whose h ends in 0 has, for its words i from a = g mod n on, the word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8). Other texts, and those
    without an id, stay as they are.
    """
    h = F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary"))
    listed = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    own = docs.withColumn("_g", F.when(h % 10 == 0, F.expr("crc32(cast(cast(`{}` as long) as string)) div 10".format(doc_id))))
    own = own.withColumn("_w", F.when(F.col("_g").isNotNull(), listed))
    n, g = F.size("_w").cast("long"), F.col("_g")
    own = own.withColumns({"_a": F.when(n > 0, g % n)})
    p = 1 + F.floor((n - F.col("_a")) / (3 + g % 8))
    own = own.withColumn("_p", p)
    place = lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")).cast("int")
    turned = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get("_w", place(i))), " ")
    return own.withColumn(text, F.when(F.col("_a").isNotNull(), turned).otherwise(F.col(text))).drop("_g", "_w", "_a", "_p")
