"""Words, hashes and windows of many texts at once, in numpy.

A word is a maximal run of bytes outside ``\\x20`` and ``\\x09-\\x0D``; those
bytes never occur inside a UTF-8 sequence, so bytes and code points agree on
the words. All arrays run over one pass of whole texts (see ``shared.passes``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

ODD = np.uint64(0x9E3779B97F4A7C15)
U = np.uint64
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], U)


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 one) over an array."""
    x = np.asarray(x, U) + U(salt * 0x9E3779B97F4A7C15 % (1 << 64))
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(values: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each of these spans, which are in order and don't overlap.

    Every value is mixed with its place in the span before the sum is taken and
    mixed again, so there is no algebra by which long spans of a pattern could
    agree, as in a polynomial; two seeds give 128 independent bits.
    """
    size, wide = end - start, 8 if values.dtype == np.uint8 else 1  # bytes go by eights
    count = -(-size // wide)
    behind = np.cumsum(count)
    before = behind - count
    place = np.arange(behind[-1] if len(size) else 0)
    at = wide * (place - np.repeat(before, count)) + np.repeat(start, count)
    if wide > 1:
        padded = np.concatenate([values, np.zeros(wide, np.uint8)])
        x = np.lib.stride_tricks.as_strided(padded, (len(values) + 1, wide), (1, 1))[at].view("<u8")[:, 0]
        x &= _LOW[np.minimum(np.repeat(end, count) - at, wide)]
    else:
        x = values[at].astype(U)
    x += (place - np.repeat(before, count)).view(U) * ODD
    total = np.zeros(len(x) + 1, U)
    np.cumsum(mix(x, 2 * seed + 1), out=total[1:])
    return mix((total[behind] - total[before]) + size.astype(U) * ODD, 2 * seed + 2)


def run_hashes(values: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` values: two runs of a power of two that overlap, each from two halves."""
    if len(values) < size:
        return np.empty(0, U)
    out, span = mix(values, 2 * seed + 51), 1
    while 2 * span <= size:
        out = mix(out[:-span] * ODD + out[span:], 2 * seed + 52)
        span *= 2
    return mix(out[: len(values) - size + 1] * ODD + out[size - span :], 2 * seed + 53) if span < size else out


@dataclass
class Words:
    start: np.ndarray  #: byte at which each word starts
    end: np.ndarray
    doc: np.ndarray  #: row of the pass that each word is in
    first: np.ndarray  #: index of each row's first word, and the number of words at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def left(self) -> np.ndarray:
        """For each word, how many words its text still has from it on."""
        return self.first[1:][self.doc] - np.arange(len(self.doc))


def words_of(buf: np.ndarray, at: np.ndarray) -> Words:
    inside = ~SPACE[buf]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    full = at[:-1] < at[1:]
    head, tail = at[:-1][full], at[1:][full] - 1
    opens[head] = inside[head]
    closes[tail] = inside[tail]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    first = np.searchsorted(start, at)
    return Words(start, end, np.repeat(np.arange(len(at) - 1), np.diff(first)), first)


def row_sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def window_starts(words: Words, size: int) -> np.ndarray:
    """Indices of the words at which ``size`` words of one text begin."""
    return np.flatnonzero(words.left() >= size)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key occurs more than once in the array."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order = np.argsort(keys, kind="stable")
        same = keys[order][1:] == keys[order][:-1]
        out[order[1:]] = same
        out[order[:-1]] |= same
    return out


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n words lie in a window of ``size`` words from one of ``starts``."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + size, -1)
    return np.cumsum(step[:-1]) > 0
