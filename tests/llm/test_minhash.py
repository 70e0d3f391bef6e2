import random

import numpy as np
from brute import ODD, docs, tokens, write
from pyspark.sql import functions as F

from plexspark.llm import minhash, words
from plexspark.llm.queries import op7_minhash_near_dedup
from plexspark.llm.shared import table

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows, size=2):
    sets = []
    for _, t in rows:
        w = tokens(lower(t))
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)), d == least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert got(op7_minhash_near_dedup(spark, SF)) == expected(rows)


def test_odd_texts(spark, tmp_path):
    rows = [*ODD, (30, "One"), (31, " one "), (32, "ONE two"), (33, "É é"), (34, "é é")]
    assert got(op7_minhash_near_dedup(spark, write(spark, tmp_path, documents=docs(spark, rows)))) == expected(rows)
    assert got(op7_minhash_near_dedup(spark, write(spark, tmp_path, documents=docs(spark, [])))) == []


def test_one_large_group_about_the_threshold(spark):
    """Members of similarity 0.5 to 0.9: a bucket's first node is linked with some of them only."""
    rng = random.Random(4)
    body = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(body)
        for _ in range(rng.randint(2, 11)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i * 7 % 151, " ".join(w)))
    rows += [(1000 + i, rows[3][1]) for i in range(50)]
    assert got(minhash.near_duplicates(docs(spark, rows), size=2)) == expected(rows)


def test_every_coordinate_fills_and_estimates():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 50, 2000):
        h = rng.integers(0, 1 << 63, n).astype(np.uint64)
        s = minhash.sketches(words.mix(h), np.zeros(n, np.int64), 1, 240)
        assert (s != minhash.EMPTY).all()
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    errors = []
    for k in range(30):
        b = np.r_[a[: 1000 - 100], rng.integers(0, 1 << 63, 100).astype(np.uint64)]
        h, row = words.mix(np.r_[a, b], k), np.repeat([0, 1], 1000)
        x, y = minhash.sketches(h, row, 2, 240)
        errors.append((x == y).mean() - 900 / 1100)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_families_around_the_limit(spark, monkeypatch):
    """Without bands' centres all pairs rest on the prefix filter: sets of many sizes that share a part of a pool."""
    monkeypatch.setattr(minhash, "STARS", 0)
    monkeypatch.setattr(minhash, "CLASS", 1.2)
    rng = random.Random(9)
    rows = []
    for f in range(12):
        body = [f"f{f}_{i}" for i in range(rng.randint(3, 60))]
        for _ in range(12):
            w = list(body)
            for _ in range(rng.randint(0, max(1, len(body) // 6))):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = [rng.choice(["x", f"y{rng.randrange(99)}"])] * rng.randint(0, 2)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + i, f"alpha beta gamma x{i}") for i in range(60)]
    known = spark.createDataFrame([(((False, i), 0), ((False, i), 0)) for i, _ in rows], f"node {minhash.NODE}, component {minhash.NODE}")
    texts = spark.createDataFrame([(((False, i), 0), t) for i, t in rows], f"node {minhash.NODE}, text string")
    pairs = {tuple(sorted((r.a.id.value, r.b.id.value))) for r in minhash._rest(known, texts, 2, True, 80).collect()}
    sets = [minhash.shingles_of(t, 2, True) for _, t in rows]
    linked = {(i, j) for j in range(len(rows)) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert linked <= pairs and len(pairs) < 3 * len(linked) + len(rows)
    assert not [p for p in pairs if p[0] >= 144]  # what they share is not rare enough for any two of them to meet
    assert got(minhash.near_duplicates(docs(spark, rows), size=2)) == expected(rows)


def test_clashing_columns(spark):
    df = docs(spark, [(1, "a b c"), (2, "A b  c"), (3, None)]).selectExpr("*", "1 AS id", "2 AS hash", "3 AS n", "4 AS node", "5 AS kept")
    assert got(minhash.near_duplicates(df)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    out = minhash.first_of_groups(df.withColumn("_hash", F.lit(1)))
    assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == [1, 3]


def test_one_row_of_each_group_stays(spark):
    rows = [(1, "one two three"), (1, "one two three"), (1, "ONE two three"), (2, "one two three"), (3, None), (3, None), (None, "x y z"), (None, "x y z"), (4, "p q r s"), (5, "\n"), (None, "one two three"), (4, "t u v")]
    kept = minhash.first_of_groups(docs(spark, rows)).collect()
    assert sorted(str((r.doc_id, (r.text or "").lower())) for r in kept) == sorted(["(1, 'one two three')", "(3, '')", "(None, 'x y z')", "(4, 'p q r s')", "(5, '\\n')", "(4, 't u v')"] + ["(3, '')"])


def test_a_centre_of_many_copies_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(minhash, "TOGETHER", 8)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[: i % 59], f"x{i}", *words[i % 59 + 1 :]])) for i in range(90)] + [(200, "other words here"), (None, " ".join(words))]
    want = minhash.near_duplicates(docs(spark, rows), size=2).collect()
    monkeypatch.setattr(minhash, "TOGETHER", 1 << 40)
    assert sorted(map(str, want)) == sorted(map(str, minhash.near_duplicates(docs(spark, rows), size=2).collect()))
    assert sum(r.kept for r in want) < 10


def test_the_largest_id_is_an_id(spark):
    most = (1 << 63) - 1
    rows = [(most, "one two three four five six"), (None, "one two three four five six"), (5, "something else altogether"), (None, "alone with these words")]
    got = minhash.near_duplicates(docs(spark, rows), size=2).collect()
    assert sorted(map(str, ((r.doc_id, r.component_id, r.kept) for r in got))) == sorted(map(str, [(most, most, True), (None, most, False), (5, 5, True), (None, None, True)]))
