import hashlib
import random
import zlib
from fractions import Fraction

from brute import ODD, docs, tokens, write

from plexspark.llm import periodic
from plexspark.llm.queries import op13_periodic_runs
from plexspark.llm.shared import table

SF = "/root/testdata/sf0.001"


def plain(text, exponent=3, least=24):
    """All runs, by looking along the text once for each period."""
    out = {}
    for q in range(1, len(text) // exponent + 1):
        i = 0
        while i + q < len(text):
            j = i
            while j + q < len(text) and text[j] == text[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                out.setdefault((i, j + q), q)  # the smallest period comes first
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in out.items())


def turned(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def expected(doc_id, text):
    words = turned(doc_id, tokens(text))
    found = plain(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(listed), sha(kept), len(words))


def drawn(rng):
    """Texts of few words with much repetition."""
    out, size, length = [], rng.choice([1, 2, 2, 3, 4, 6]), rng.randint(0, 70)
    while len(out) < length:
        unit = [rng.randrange(size) for _ in range(rng.randint(1, 9))]
        out += (unit * rng.randint(1, 6))[: rng.randint(1, 40)]
        if rng.random() < 0.4:
            at = rng.randrange(len(out))
            out += out[at : at + rng.randint(1, 30)]
    return out


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(1500):
        text = drawn(rng)
        for exponent, least in ((2, 1), (3, 1), (3, 9), (3, 24), (4, 10)):
            assert periodic.runs(text, exponent, least) == plain(text, exponent, least)


def test_factors_are_the_longest_that_start_earlier():
    rng = random.Random(2)
    for _ in range(300):
        text = drawn(rng)
        at = 0
        for b, f, back in periodic.factors(text):
            assert b == at and (text[b:f] == text[b - back : f - back] if back else f == b + 1 and text[b] not in text[:b])
            assert not back or f == len(text) or all(text[s : s + f - b + 1] != text[b : f + 1] for s in range(b))
            at = f
        assert at == len(text)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r[0]: tuple(r) for r in op13_periodic_runs(spark, SF).collect()}
    assert len(got) == len(rows)
    for doc_id, text in rows:
        if len(tokens(text)) < 1000:
            assert got[doc_id] == expected(doc_id, text)
    assert any(r[1] for r in got.values())


def test_odd_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = ODD + [(100 + i, " ".join(f"w{x}" for x in drawn(rng))) for i in range(200)]
    rows += [(400, "a " * 30_000), (401, " ".join(f"v{i % 700}" for i in range(20_000))), (402, "one two " * 11 + "one"), (403, "one two " * 12)]
    sf = write(spark, tmp_path, documents=docs(spark, rows).selectExpr("*", "1 AS periodic", "2 AS runs", "3 AS best"))
    got = sorted((tuple(r) for r in op13_periodic_runs(spark, sf).collect()), key=str)
    small = [r for r in rows if r[0] not in (9, 401)]
    assert sorted((r for r in got if r[0] not in (9, 401)), key=str) == sorted((expected(*r) for r in small), key=str)
    assert [r[1:6] for r in got if r[0] == 401] == [(1, 0, 20_000, 700, 28571)] if zlib.crc32(b"401") % 10 else True
    assert periodic.find_runs(docs(spark, [])).count() == 0


def test_operator_keeps_columns_and_texts(spark):
    df = docs(spark, [(1, "x " + "a b c " * 9 + "y"), (2, None)]).selectExpr("*", "9 AS periodic")
    out = periodic.find_runs(df)
    assert out.columns == [*[c for c in df.columns if c != "periodic"], "periodic"]
    got = {r.doc_id: r.periodic for r in out.collect()}
    assert got[1].collapsed == "x a b c y" and [tuple(r) for r in got[1].runs] == [(1, 27, 3)] and got[1].n_words == 29
    assert got[2] == (0, [], "")
