import random

import numpy as np
from brute import ODD, docs, tokens, write

from plexspark.llm import decontam
from plexspark.llm.queries import op2_decontamination
from plexspark.llm.shared import table

SF = "/root/testdata/sf0.001"


def low(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in tokens(text)]


def distance(item, text):
    """Least edits between the item and a run of the text, row by row; and where the first such run ends."""
    row = list(range(len(item) + 1))
    best, end = row[-1], 0
    for j, x in enumerate(text):
        new = [0]
        for i, y in enumerate(item):
            new.append(min(new[i] + 1, row[i + 1] + 1, row[i] + (x != y)))
        row = new
        if row[-1] < best:
            best, end = row[-1], j + 1
    return best, end


def expected(rows, items, edits=0.2):
    out = []
    for d, t in rows:
        text = low(t)
        for i, x in items:
            item = low(x)
            if item and len(set(item) & set(text)) >= 0.5 * len(set(item)):  # an item whose words are elsewhere is not leaked
                k, end = distance(item, text)
                if k <= edits * len(item):
                    out.append((d, i, len(item), k, end))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    want = expected(rows, items)
    assert want and got(op2_decontamination(spark, SF)) == want


def test_odd_texts_and_items(spark, tmp_path):
    items = [(1, None), (2, ""), (3, "one"), (4, "TWO one"), (None, "a b c d e"), (5, "a b c d e"), (5, "a b c d e"), (6, "é ü#*$"), (7, "w7 w8 w9 w10 w11 w12 w13 w14 w15 w16 w17")]
    rows = [r for r in ODD if len(r[1] or "") < 100_000]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    sf = write(spark, tmp_path, documents=docs(spark, rows + [(40, " ".join(f"w{i}" for i in range(30)))]), benchmark=benchmark)
    assert got(op2_decontamination(spark, sf)) == expected(rows + [(40, " ".join(f"w{i}" for i in range(30)))], items)
    assert decontam.leaks(docs(spark, []), benchmark).count() == 0
    assert decontam.leaks(docs(spark, rows), benchmark.limit(0)).count() == 0
    assert decontam.remove_leaks(docs(spark, rows), benchmark.limit(0)).count() == len(rows)


def test_recall_of_edited_copies_and_clean_documents(spark):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and", "a"] * 60 + ["".join(rng.choices("abcdefghij", k=5)) for _ in range(800)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 60)))) for i in range(120)]
    for share, least in ((0.0, 1.0), (0.1, 0.97), (0.2, 0.9)):
        rows = []
        for i, x in items:
            w = x.split()
            for _ in range(int(share * len(w))):
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choices(vocabulary, k=rng.randint(0, 1))
            rows.append((i, " ".join([*rng.choices(vocabulary, k=40), *w, *rng.choices(vocabulary, k=40)])))
        want = expected(rows, items)
        found = got(decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")))
        assert set(found) <= set(want) and len(found) >= least * len(want)
    clean = [(i, " ".join(rng.choices(vocabulary, k=200))) for i in range(50)]
    assert got(decontam.leaks(docs(spark, clean), spark.createDataFrame(items, "item_id long, text string"))) == []


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 8)
    items = [(i, " ".join(f"q{i}_{k}" for k in range(10))) for i in range(20)]
    rows = [(i, f"before {x} after") for i, x in items]
    assert got(decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))) == expected(rows, items)


def test_removal(spark):
    items = spark.createDataFrame([(1, "this is the question that nobody should see")], "item_id long, text string")
    rows = [(1, "clean"), (2, "x THIS is the question that nobody should see y"), (None, "fine"), (3, None)]
    assert sorted((r.doc_id for r in decontam.remove_leaks(docs(spark, rows), items).collect()), key=str) == [1, 3, None]


def test_edits_in_one_place(spark):
    """As many edits as an item may have, all at its start, middle or end, or evenly spread, for items of 5 to 200 words."""
    rng = random.Random(8)
    items, rows = [], []
    for n in [*range(5, 61), 80, 120, 200]:
        words = [f"v{n}_{i}" for i in range(n)]
        k = n // 5
        items.append((n, " ".join(words)))
        for places in (range(k), range((n - k) // 2, (n - k) // 2 + k), range(n - k, n), range(2, n, 5)):
            for kind in ("change", "drop", "insert"):
                w = list(words)
                for i in sorted(list(places)[:k], reverse=True):
                    w[i : i + (kind != "insert")] = [] if kind == "drop" else [f"x{rng.random()}"]
                rows.append((len(rows), " ".join(["before"] * rng.randint(0, 9) + w + ["after"] * rng.randint(0, 9))))
    want = sorted((d, i, i, *distance(low(x), low(t))) for d, t in rows for i, x in [items[d // 12]])
    assert all(k <= 0.2 * n for _, _, n, k, _ in want)
    assert sorted(tuple(r) for r in decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()) == want


def test_a_leak_close_after_a_false_candidate():
    item = [b"q%d" % i for i in range(20)]
    leak = [item[0], *[b"x"] * 4, *item[1:]]  # 4 insertions, words 39 to 62
    text = [b"a%d" % i for i in range(39)] + leak + [b"z"] * 30
    assert decontam.near(item, text, [0, 39], 0.2) and not decontam.near(item, text, [0, 12], 0.2)
    assert not decontam.near(item, text[:39], [0, 5], 0.2) and not decontam.near(item, text, [], 0.2)
    rng = random.Random(2)
    for _ in range(300):
        item = rng.choices([b"a", b"b", b"c"], k=rng.randint(1, 12))
        text = rng.choices([b"a", b"b", b"c", b"d"], k=rng.randint(0, 40))
        assert decontam.near(item, text, list(range(-2, len(text))), 0.2) == (distance(item, text)[0] <= 0.2 * len(item))


def test_repeated_items_are_indexed_once(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 8)
    sizes, search = [], decontam._search
    monkeypatch.setattr(decontam, "_search", lambda docs, items, edits: sizes.append(len(items)) or search(docs, items, edits))
    items = [(i, " ".join(f"q{i}_{k}" for k in range(10))) for i in range(10)]
    items += [(i, items[3][1]) for i in (3, 3, 20, None, None) for _ in range(8)]
    rows = [(i, f"before {x} after") for i, x in items[:10]]
    assert got(decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))) == expected(rows, items)
    assert sum(sizes) == 10


def test_rows_that_share_an_id_go_one_by_one(spark):
    items = spark.createDataFrame([(1, "this is the question that nobody should see")], "item_id long, text string")
    leak = "x this is the question that nobody should see y"
    rows = [(7, leak), (7, "clean"), (7, leak), (None, leak), (None, "fine"), (None, None), (8, "also clean")]
    df = docs(spark, rows).selectExpr("*", "1 AS _hash", "2 AS key", "3 AS item_id")
    out = decontam.remove_leaks(df, items)
    assert out.columns == [c for c in df.columns if c != "_hash"]
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == [("7", "clean"), ("8", "also clean"), ("None", "None"), ("None", "fine")]
    extra = items.selectExpr("*", "1 AS doc_id", "2 AS t")
    assert sorted(str(r.doc_id) for r in decontam.leaks(df, extra).collect()) == ["7", "7", "None"]


def test_long_texts(spark):
    """Leaks at the start, in the middle and at the end of texts of many words."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 50)))) for i in range(20)]
    rows = []
    for i, x in items:
        w = x.split()
        w[len(w) // 2] = "changed"
        body = [word() for _ in range(30_000)]
        at = (0, 15_000, 30_000)[i % 3]
        rows.append((i, " ".join(body[:at] + w + body[at:])))
    rows += [(30, " ".join(word() for _ in range(60_000))), (31, "x" * 500_000)]
    found = decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = [(i, i, len(low(x)), *distance(low(x), low(t))) for (i, x), (_, t) in zip(items, rows, strict=False)]
    assert sorted(tuple(r) for r in found) == want and {r[3] for r in want} == {1}


def test_recall_of_windows(spark):
    """As many random edits as an item may have, by length and kind; and with half of them."""
    rng = random.Random(11)
    items, rows, wants = [], [], {}
    for n in (8, 12, 20, 35, 60, 100):
        for kind in ("change", "drop", "insert", "mixed"):
            for share in (0.1, 0.2):
                for trial in range(6):
                    words = [f"t{len(items)}_{i}" for i in range(n)]
                    w = list(words)
                    for i in sorted(rng.sample(range(n), int(share * n)), reverse=True):
                        does = rng.choice(["change", "drop", "insert"]) if kind == "mixed" else kind
                        w[i : i + (does != "insert")] = [] if does == "drop" else [f"x{rng.random()}"]
                    items.append((len(items), " ".join(words)))
                    rows.append((len(rows), " ".join([*(f"b{i}" for i in range(rng.randint(0, 30))), *w, *(f"a{i}" for i in range(30))])))
                    wants.setdefault((n, kind, share), []).append(len(rows) - 1)
    found = {r.doc_id for r in decontam.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect() if r.doc_id == r.item_id}
    for (n, kind, share), ids in wants.items():
        assert len(found.intersection(ids)) >= 0.9 * len(ids) - 1, (n, kind, share)
    assert len(found) >= (0.98 if found else 1) * len(rows)


def test_a_shared_phrase_makes_no_candidates():
    """Items that begin alike, texts full of that phrase: candidates don't grow with the number of items."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    counts = []
    text = " ".join(" ".join(["which of the", *(word() for _ in range(5))]) for _ in range(60))
    buf = np.frombuffer(text.encode(), np.uint8)
    w = decontam.words.words_of(buf, np.array([0, len(buf)]))
    hashes = decontam.words.span_hashes(buf, w.start, w.end)
    for n in (500, 2000):
        index = decontam.Index([(str(i), " ".join(["which of the", *(word() for _ in range(12))])) for i in range(n)], 0.2)
        counts.append(sum(len(b) for _, _, b in index.candidates(hashes, w.first, w.doc)))
    assert max(counts) < 20
