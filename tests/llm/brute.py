"""Plain restatements of what the operators promise, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def tokens(text):
    return WORD.findall(text or "")


def docs(spark, rows):
    """A documents table of (doc_id, text) with the usual further columns."""
    full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def write(spark, tmp_path, **tables):
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one\ntwo\none\n\n two\ntwo"), (6, "a b c d e f g h " * 30), (7, "é ü#*$ <b>|%&"), (None, "a null id with some words in it"),
    (8, "x" * 200_000), (9, " ".join(f"w{i}" for i in range(40_000))), (10, "same text twice"), (10, "same text twice"), (11, "\u00a0no\u2003break \u3000spaces"), (12, "\r\nline\r\nline\r\n"),
]
