import itertools
import random
import zlib

import numpy as np
import pytest
from brute import ODD, docs, write
from pyspark.sql import functions as F

from plexspark.llm import toxicity
from plexspark.llm.queries import op11_toxicity
from plexspark.llm.shared import table

SF = "/root/testdata/sf0.01"
RUDE = ["idiot", "stupid", "clown", "worthless"]


@pytest.fixture(scope="module")
def price(spark):
    return toxicity.language_model(table(spark, SF, "documents"))


def restored(price, text):
    buf = np.frombuffer(text.encode(), np.uint8)
    s = toxicity.Sorted(buf, np.array([0, len(buf)]))
    raw, changed, out, i = s.buf.tobytes(), {a: (z, t) for a, z, t in toxicity.Restorer(price).changes(s)}, [], 0
    while i < len(s.start):
        i, word = changed.get(i) or (i + 1, raw[s.start[i] : s.end[i]].decode())
        out.append(word)
    return " ".join(out)


def test_restored_words(price):
    for hidden in ("1d1ot", "i.d.i.o.t", "I-D-I-O-T", "iiidiooot", "i d i o t", "1 d i 0 t", "idi0t!!!", "idiot$$$", "***idiot###"):
        assert restored(price, f"the and {hidden} of") == "the and idiot of"
    assert restored(price, "5tup1d cl0wn w0rthl3ss") == "stupid clown worthless"
    assert restored(price, 'Plain "words", (stay) as they are.') == "plain words stay as they are"


def test_language_model_counts_trigrams():
    text = "ab, B-a éaü 7x cc".encode()
    counts = toxicity.Sorted(np.frombuffer(text, np.uint8), np.array([0, len(text)])).counts().reshape((28,) * 3)
    want = np.zeros((28,) * 3, int)
    for word in ([1, 2], [27, 1, 27], [3, 3]):  # words with signs inside are left out
        for x, y, z in zip([0, 0, *word], [0, *word], [*word, 0], strict=False):
            want[x, y, z] += 1
    assert (counts == want).all()


def test_viterbi_finds_the_cheapest_path(price):
    rng = random.Random(2)
    for _ in range(150):
        units = toxicity.lattice("".join(rng.choices("abst0135$!.7", k=rng.randint(1, 7))))
        best = None
        for path in itertools.product(*units):
            total, x, y = 0.0, 0, 0
            for symbols, _, more in path:
                total += more
                for s in symbols:
                    if s or y:
                        total += price[(x * 28 + y) * 28 + s]
                        x, y = (y, s) if s else (0, 0)
            total += price[(x * 28 + y) * 28] if y else 0
            if best is None or total < best[0] - 1e-9:
                best = (total, {"".join(t for _, t, _ in path)})
            elif total < best[0] + 1e-9:
                best[1].add("".join(t for _, t, _ in path))
        assert toxicity.decode(units, price) in best[1]


def test_held_out_accuracy(spark):
    large = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in table(spark, large, "labels").collect()}
    rows = op11_toxicity(spark, large).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    found = [(p, t) for p, t in held if p or t]
    assert sum(p == t for p, t in held) > 0.97 * len(held) and sum(p and t for p, t in held) >= 0.8 * len(found)


def test_disguised_documents(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = ["the", "ander", "thing", "ofher", "reon", "edly", "tion", "house", "water", "light"]
    prose = lambda: rng.choices(vocabulary, k=60)
    rows, labels = [], []
    for i in range(300):
        words = prose()
        if i % 4 == 0:
            words[rng.randrange(60)] = rng.choice(RUDE)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 4 == 0)))
    hidden = ["5tup1d", "s t u p i d", "i.d.i.o.t", "cl0wn", "STUUUPID", "w0rthl3ss", "c l 0 w n"]
    for i, x in enumerate(hidden):
        rows.append((1000 + i, " ".join([*prose(), x, *prose()])))
    rows += [(2000 + i, " ".join(prose() + prose())) for i in range(20)]
    sf = write(spark, tmp_path, documents=docs(spark, rows), labels=spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r.doc_id: r.predicted for r in op11_toxicity(spark, sf).collect()}
    assert all(got[1000 + i] for i in range(len(hidden))) and not any(got[2000 + i] for i in range(20))


def test_odd_rows(spark, tmp_path):
    labels = [(4, 1), (4, 0), (5, 0), (None, 1), (6, None), (10, 1), (99, 1), (12, 0)]
    df = docs(spark, ODD).selectExpr("*", "1 AS toxic", "2 AS score", "3 AS label")
    sf = write(spark, tmp_path, documents=df, labels=spark.createDataFrame(labels, "doc_id long, toxic int").selectExpr("*", "'x' AS text"))
    rows = op11_toxicity(spark, sf).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in ODD), key=str)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in rows if r.doc_id == 10}) == 1
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    assert toxicity.score(df.limit(0), known).count() == 0
    assert {r.score for r in toxicity.score(df, known.limit(0)).collect()} == {0.0}
    assert {r.score for r in toxicity.score(df, known.where("toxic = 1")).collect()} == {1.0}


def test_restored_column(spark, price):
    df = docs(spark, [(1, "The i d i o t, cl0wn!"), (2, None), (3, " "), (4, "x" * 3000)]).selectExpr("*", "1 AS restored")
    out = toxicity.restore(df, price)
    assert out.columns == [*[c for c in df.columns if c != "restored"], "restored"]
    assert {r.doc_id: r.restored for r in out.select("doc_id", F.substring("restored", 1, 20).alias("restored")).collect()} == {1: "the idiot clown", 2: "", 3: "", 4: "x"} or out.where("doc_id = 4").first().restored in ("x", "xx")
