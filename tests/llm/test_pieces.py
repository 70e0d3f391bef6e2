import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from brute import ODD, docs, write
from hypothesis import given, settings
from hypothesis import strategies as st

from plexspark.llm import pieces
from plexspark.llm.queries import op6_merge_dropout
from plexspark.llm.shared import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v():
    return pieces.vocabulary(pieces.MODEL)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)


def agenda(v, text, key, rate):
    """One text by the plain rule: over and over the best candidate that is not dropped, leftmost first."""
    if not text:
        return []
    syms = [(int(v.char[ord(c)]) if c != pieces.MARK else -1, i, i + 1, c) for i, c in enumerate(" " + text)]
    while True:
        best = None
        for n, (a, b) in enumerate(zip(syms, syms[1:], strict=False)):
            made = v.pairs.get(a[0] * v.size + b[0], -1) if a[0] >= 0 and b[0] >= 0 else -1
            if made >= 0 and not (rate and pieces.skipped(np.array([key], np.uint64), *(np.array([x]) for x in (a[1], b[1], b[2])), rate)[0]):
                best = min(best or (1 << 60, 0, 0), (int(v.order[made]), n, made))
        if best is None:
            break
        _, n, made = best
        syms[n : n + 2] = [(made, syms[n][1], syms[n + 1][2], None)]
    return [j for i, _, _, c in syms for j in ([i] if i >= 0 else v.byte[list(c.encode())].tolist())]


TEXTS = ["", " ", "  a  b\n\n c ", "hello world", "the the  the\nthe", "😀 é\t\tz ▁x", "x" * 70, "w" * 30 + " " + "no" * 40, "éà" * 50 + " ok", "  a b", "\n\n"]


def test_without_dropout_it_is_the_library(v, library, spark):
    texts = [r.text for r in table(spark, SF, "documents").collect() if r.text] + [t for t in TEXTS if pieces.MARK not in t]
    got = pieces.encode(v, texts, np.zeros(len(texts), np.uint64))
    assert [g.tolist() for g in got] == [library.encode(t) for t in texts]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_agenda_with_dropout(v, rate):
    rng = random.Random(2)
    texts = TEXTS + [" ".join("".join(rng.choices("thean onris", k=rng.randint(1, 12))) for _ in range(6)) for _ in range(30)]
    keys = np.arange(len(texts)).astype(np.uint64) * np.uint64(77)
    got = pieces.encode(v, texts, keys, rate)
    assert [g.tolist() for g in got] == [agenda(v, t, int(k), rate) for t, k in zip(texts, keys, strict=True)]
    assert [pieces.decode(v, g.tolist()) if t else "" for t, g in zip(texts, got, strict=True)] == texts


@settings(max_examples=60, deadline=None)
@given(st.text(), st.integers(0, 2**63))
def test_any_text_comes_back(text, key):
    v = pieces.vocabulary(pieces.MODEL)
    for rate in (0.0, 0.3):
        (ids,) = pieces.encode(v, [text], np.array([key], np.uint64), rate)
        assert not text or pieces.decode(v, ids.tolist()) == text


def test_query(spark, tmp_path):
    rows = op6_merge_dropout(spark, write(spark, tmp_path, documents=docs(spark, ODD))).collect()
    assert len(rows) == len(ODD) and all(r.round_trip or r.ids is None for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[1].ids is None and by[2].ids == [] and by[2].n_pieces == 0
    assert len({tuple(r.ids) for r in rows if r.doc_id == 10}) == 1


def test_whole_query_equals_the_plain_rule(spark, tmp_path, v):
    """Rows with their keys, as the query deals them, against the agenda one candidate at a time."""
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a null id"), (50, None), (-3, "below zero"), (2**62, "far")]
    rows += [(100 + i, " ".join("".join(rng.choices("thean onris", k=rng.randint(1, 9))) for _ in range(8))) for i in range(60)]
    mix = lambda x, salt: splitmix((x + salt * 0x9E3779B97F4A7C15) % 2**64)

    def splitmix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    got = Counter((r.doc_id, r.n_pieces, None if r.ids is None else tuple(r.ids), r.round_trip) for r in op6_merge_dropout(spark, write(spark, tmp_path, documents=docs(spark, rows))).collect())
    want = []
    for i, t in rows:
        key = mix((2**64 - 1 if i is None else i % 2**63) ^ mix(1, 3), 5)
        ids = None if t is None else tuple(agenda(v, t, key, 0.1))
        want.append((i, -1 if ids is None else len(ids), ids, None if t is None else True))
    assert {w[:1] + w[2:] for w in want} == {g[:1] + g[2:] for g in got} and all(g[1] == len(g[2]) for g in got if g[2] is not None)


def test_seeds_vary_and_repeat(spark):
    df = docs(spark, [(i, "the international organisation of understanding") for i in range(40)])
    ids = lambda seed: {r.doc_id: tuple(r.pieces.ids) for r in pieces.encode_documents(df, rate=0.2, seed=seed).collect()}
    a, b = ids(1), ids(2)
    assert a == ids(1) and a != b and len(set(a.values())) > 20


def test_empty_table_and_clashing_column(spark):
    out = pieces.encode_documents(docs(spark, []).selectExpr("*", "1 AS pieces", "2 AS ids"))
    assert out.count() == 0 and out.columns[-2:] == ["ids", "pieces"]
