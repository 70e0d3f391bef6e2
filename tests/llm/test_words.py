import random

import numpy as np
import pytest
from brute import docs
from test_minhash import expected as grouped
from test_minhash import got as groups
from test_quality import expected as judged
from test_substrings import expected as removed
from test_substrings import got as left

from plexspark.llm import minhash, quality, substrings, words


def morse(n, a="a", b="b"):
    """A word of 2**n letters on which every polynomial modulo 2**64 agrees with its complement (from n = 10 or 11 on)."""
    w = a
    for _ in range(n):
        w += w.translate(str.maketrans(a + b, b + a))
    return w


PAIR = [(morse(n), morse(n, "b", "a")) for n in (10, 11, 12)]


def test_spans_and_runs_agree_where_contents_do():
    rng = random.Random(1)
    texts = [bytes(rng.choices(b"ab\0", k=rng.randrange(20))) for _ in range(20_000)]
    buf, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    for seed in (0, 1):
        h = words.span_hashes(buf, at[:-1], at[1:], seed).tolist()
        by = dict(zip(texts, h, strict=True))
        assert all(by[t] == x for t, x in zip(texts, h, strict=True)) and len(set(h)) == len(by)
    values = np.array(rng.choices(range(3), k=5000), np.uint64)
    for size in (1, 2, 3, 8, 35):
        h = words.run_hashes(values, size).tolist()
        by = {}
        for i, x in enumerate(h):
            assert by.setdefault(tuple(values[i : i + size].tolist()), x) == x
        assert len(h) == 5001 - size and len(set(by.values())) == len(by)
    assert not len(words.run_hashes(values[:3], 8)) and not len(words.span_hashes(buf, at[:0], at[:0]))


@pytest.mark.parametrize("pair", PAIR)
def test_patterns_that_polynomials_confuse(spark, pair):
    a, b = pair
    both = words.span_hashes(np.frombuffer((a + b).encode(), np.uint8), np.array([0, len(a)]), np.array([len(a), 2 * len(a)]))
    assert both[0] != both[1]
    if len(a) > 1024:
        return
    filler = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join([*filler[:20], a, *filler[20:]])), (2, " ".join([*filler[:20], b, *filler[20:]])), (3, a), (4, b), (5, f"{a}\n{b}\n")]
    assert left(substrings.repeated_spans(docs(spark, rows))) == removed(rows)
    assert groups(minhash.near_duplicates(docs(spark, rows), size=2)) == grouped(rows)
    got = quality.quality(docs(spark, rows)).select("doc_id", "quality.*").collect()
    assert sorted((r[0], *r[1:6]) for r in got) == sorted((i, *judged(t)[:5]) for i, t in rows)
