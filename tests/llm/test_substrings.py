import hashlib
import random

import pytest
from brute import ODD, docs, tokens, write

from plexspark.llm import substrings
from plexspark.llm.queries import op9_substring_dedup
from plexspark.llm.shared import table

SF = "/root/testdata/sf0.001"


def expected(rows, size=35):
    at = {}
    texts = [tokens(t) for _, t in rows]
    for n, w in enumerate(texts):
        for i in range(len(w) - size + 1):
            at.setdefault(tuple(w[i : i + size]), []).append((n, i))
    gone = [set() for _ in rows]
    for places in at.values():
        if len(places) > 1:
            for n, i in places:
                gone[n].update(range(i, i + size))
    sha = lambda w: hashlib.sha256(" ".join(w).encode()).hexdigest()
    return sorted(((d, len(w), len(g), sha([x for i, x in enumerate(w) if i not in g])) for (d, _), w, g in zip(rows, texts, gone, strict=True)), key=str)


def got(df):
    return sorted((tuple(r)[:4] for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert got(op9_substring_dedup(spark, SF)) == expected(rows)


def test_odd_texts(spark, tmp_path):
    rng = random.Random(1)
    w = [f"v{i}" for i in range(200)]
    passage = w[:60]
    rows = [*ODD, (57, " ".join(f"w{i}" for i in range(39_000, 41_000)))]
    rows += [(50, "on " * 200), (51, "on on off " * 40), (52, " ".join(passage + w[60:90] + passage)), (53, " ".join(w[100:120] + passage[10:50])), (54, " ".join(passage[:35])), (55, " ".join(passage[:34])), (None, "\t".join(passage[20:]))]
    rows += [(60 + i, " ".join(rng.choices("ab", k=70))) for i in range(20)] + [(56, "Passage " + " ".join(w[150:]).upper())]
    assert got(op9_substring_dedup(spark, write(spark, tmp_path, documents=docs(spark, rows)))) == expected(rows)
    assert got(op9_substring_dedup(spark, write(spark, tmp_path, documents=docs(spark, [])))) == []


def test_many_shards_and_copies(spark, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_WORDS", 60)
    monkeypatch.setattr(substrings, "COPY_WORDS", 500)
    rng = random.Random(2)
    passages = [[f"p{k}_{i}" for i in range(rng.randint(30, 80))] for k in range(12)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(3):
            p = passages[0] if rng.random() < 0.4 else rng.choice(passages)
            lo = rng.randrange(10)
            w += [f"d{d}_{rng.random()}" for _ in range(rng.randrange(20))] + p[lo : len(p) - rng.randrange(10)]
        rows.append((d, " ".join(w)))
    assert got(substrings.repeated_spans(docs(spark, rows))) == expected(rows)


def test_automaton_matching_statistics():
    rng = random.Random(3)
    for _ in range(40):
        passages = [rng.choices([b"a", b"b", b"c"], k=rng.randint(1, 12)) for _ in range(4)]
        machine = substrings.Automaton()
        for p in passages:
            machine.add(p)
        text = rng.choices([b"a", b"b", b"c", b"d"], k=30)
        inside = {tuple(p[i:j]) for p in passages for i in range(len(p)) for j in range(i + 1, len(p) + 1)}
        want = {k for i in range(len(text) - 2) for k in range(i, i + 3) if tuple(text[i : i + 3]) in inside}
        assert {k for a, b in machine.matches(text, 3) for k in range(a, b)} == want


def test_window_must_hold_a_gram(spark):
    with pytest.raises(ValueError):
        substrings.repeated_spans(docs(spark, []), window=7)


def test_one_gram_in_many_passages(spark, monkeypatch):
    """A gram with more passages than a shard may hold is split; so is a long passage."""
    monkeypatch.setattr(substrings, "SHARD_WORDS", 2000)
    monkeypatch.setattr(substrings, "RUN", 16)
    gram = [f"g{i}" for i in range(8)]
    rows = [(2 * k + d, " ".join([f"a{k}_{i}" for i in range(14)] + gram + [f"b{k}_{i}" for i in range(14)] + ["x"] * (1 + d))) for k in range(1000) for d in (0, 1)]
    long = " ".join(f"q{i}" for i in range(3000))
    rows += [(3000, long), (3001, f"own words {long}"), (3002, "on " * 5000), (3003, "line of it " * 100)]
    assert got(substrings.repeated_spans(docs(spark, rows))) == expected(rows)


def test_as_many_regions_for_any_size_of_shards(spark, monkeypatch):
    counts, real = [], substrings._regions
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    for size in (150_000, 5000):
        monkeypatch.setattr(substrings, "SHARD_WORDS", size)
        made = []
        monkeypatch.setattr(substrings, "_regions", lambda *a, made=made: made.append((real(*a).count(), a[2])) or real(*a))
        assert got(substrings.repeated_spans(docs(spark, rows))) == expected(rows)
        counts.append(made)
    assert [n for n, _ in counts[0]] == [n for n, _ in counts[1]] and counts[0][0][1] < counts[1][0][1]


def test_extra_columns_and_a_long_text(spark):
    words = [f"z{i % 70_001}" for i in range(200_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[5:60])), (3, None)]
    df = docs(spark, rows).selectExpr("*", "1 AS n_words", "2 AS id", "3 AS hash", "4 AS spans")
    assert got(substrings.repeated_spans(df)) == expected(rows)


def test_nodes_of_one_number(spark, monkeypatch):
    """Two texts whose numbers clash are told apart by the hashes of their windows."""
    from pyspark.sql import functions as F

    real = F.xxhash64
    monkeypatch.setattr(substrings.F, "xxhash64", lambda *c: F.lit(5).cast("long") if c == ("id", "hash") else real(*c))
    p, q = [" ".join(f"{x}{i}" for i in range(60)) for x in "pq"]
    rows = [(1, f"a b {p}"), (2, f"{p} c d"), (3, f"e {q}"), (4, f"{q} " + "own words " * 40), (5, " ".join(f"z{i}" for i in range(300)))]
    assert got(substrings.repeated_spans(docs(spark, rows))) == expected(rows)


def test_the_largest_id_is_an_id(spark):
    most = (1 << 63) - 1
    text = " ".join(f"w{i}" for i in range(40))
    got = substrings.repeated_spans(docs(spark, [(most, text), (None, text), (0, "few words")]), window=35).collect()
    assert sorted(map(str, ((r.doc_id, r.n_removed) for r in got))) == sorted(map(str, [(most, 40), (None, 40), (0, 0)]))
