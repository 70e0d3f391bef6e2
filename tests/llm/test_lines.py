import hashlib
import time
from collections import Counter

from brute import ODD, docs

from plexspark.llm import lines

BLANK = " \t\n\r\x0b\x0c"


def chunks(text):
    """(first line, lines) of each chunk."""
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    all_lines, out, at = text.split("\n"), [], 0
    hashes = [md5(x) for x in all_lines]
    for i in range(len(all_lines)):
        if i == len(all_lines) - 1 or md5((hashes[i - 1] if i else "") + hashes[i])[0] < "5":
            out.append((at, all_lines[at : i + 1]))
            at = i + 1
    return out


def expected(rows):
    first = {}
    real = sorted({(-1 if i is None else i, t) for i, t in rows if t is not None})
    worded = lambda c: len(c) > 1 and sum(bool(x.strip(BLANK)) for x in c) > 1
    for i, t in real:
        for at, c in chunks(t):
            if worded(c):
                first.setdefault(tuple(c), (i, t, at))
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        key = (-1 if i is None else i, t)
        stay = [c for at, c in chunks(t) if not worded(c) or first[tuple(c)] == (*key, at)]
        n = t.count("\n") + 1
        out.append((i, "\n".join(x for c in stay for x in c), n, n - sum(map(len, stay))))
    return Counter(out)


def got(spark, rows):
    return Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(docs(spark, rows)).collect())


def test_shifted_blocks_are_cut(spark):
    block = [f"a line of the block, number {i}" for i in range(40)]
    rows = [(1, "\n".join(block))] + [(10 + k, "\n".join([f"own line {k} {j}" for j in range(k)] + block + [f"after {k}"])) for k in range(1, 6)]
    result = got(spark, rows)
    assert result == expected(rows)
    assert all(r[3] >= 25 for r in result if r[0] >= 10) and next(r for r in result if r[0] == 1)[3] == 0


def test_odd_texts(spark):
    rows = [*ODD, (20, "a\nb\nc\nd\ne\nf\ng\nh\n" * 50), (21, "\n\n\n\n\n\n"), (22, "\n\n\n\n\n\n"), (None, "p\nq\nr\ns\nt\nu"), (3, "p\nq\nr\ns\nt\nu")]
    assert got(spark, rows) == expected(rows)


def test_empty_table_clashing_columns_and_long_text(spark):
    df = docs(spark, []).selectExpr("*", "1 AS n_lines", "2 AS _chunks")
    out = lines.dedup_lines(df)
    assert out.count() == 0 and out.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_lines", "n_removed"]
    began = time.time()
    rows = [(1, "\n".join(f"line {i % 50_000}" for i in range(150_000))), (2, "x")]
    assert got(spark, rows) == expected(rows)
    assert time.time() - began < 60
