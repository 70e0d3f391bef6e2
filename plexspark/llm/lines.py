"""Line dedup (operator 4): content-defined chunks of lines.

A hash that rolls over the hashes of the last ``WINDOW`` lines decides after
which lines a chunk ends. The decision depends on those lines alone, so a block
of lines falls into the same chunks wherever it stands, whatever comes before
it. A chunk with two or more lines that have text, and whose bytes occur
elsewhere too, stays only where it occurs first: at the smallest doc_id, then
the smallest line.

DataFrame functions only. Hashes find the chunks that may repeat; only those
are then compared as bytes. What is exchanged for all documents is one short
row per chunk, and the documents once; a chunk that occurs everywhere is
aggregated before it is exchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexspark.llm import shared

#: Lines that the rolling hash covers.
WINDOW = 2
#: A chunk ends where the first hex digit of the rolling hash is below this, one line in 16 / 5 on average.
BELOW = "5"
BLANK = " \t\n\r\x0b\x0c"
SHIFT = 1 << 31


def _ends(hashes: Column) -> Column:
    """The last line of each chunk, from the hashes of a text's lines."""
    rolled = lambda i: F.concat(*[F.coalesce(F.get(hashes, i - k), F.lit("")) for k in range(WINDOW - 1, -1, -1)])
    all_lines = F.sequence(F.lit(0), F.size(hashes) - 1)
    return F.filter(all_lines, lambda i: (i == F.size(hashes) - 1) | (F.substring(F.md5(rolled(i)), 1, 1) < BELOW))


def _packed(ends: Column) -> Column:
    """Chunks as first * 2**31 + last, lines counted from 0."""
    starts = F.concat(F.array(F.lit(0)), F.transform(F.slice(ends, 1, F.size(ends) - 1), lambda e: e + 1))
    return F.zip_with(starts, ends, lambda a, b: a.cast("long") * SHIFT + b)


def _first(c: Column) -> Column:
    return F.shiftright(c, 31).cast("int")


def _last(c: Column) -> Column:
    return c.bitwiseAND(F.lit(SHIFT - 1)).cast("int")


def _text(lines: Column, c: Column) -> Column:
    return F.array_join(F.slice(lines, _first(c) + 1, _last(c) - _first(c) + 1), "\n")


def _cut_up(docs: DataFrame, text: str) -> DataFrame:
    """With ``_lines`` and ``_chunks`` of each text; the steps are kept apart, so that nothing is computed again for every line."""
    docs = docs.withColumn("_lines", F.split(F.col(text), "\n", -1))
    docs = docs.withColumn("_hashes", F.transform("_lines", lambda x: F.md5(x)))
    docs = docs.withColumn("_ends", _ends(F.col("_hashes")))
    return docs.withColumn("_chunks", _packed(F.col("_ends"))).drop("_hashes", "_ends")


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated chunks cut out of ``text``, and ``n_lines`` and ``n_removed`` (lines).

    A null text stays null with no lines; an empty text has one line, which is
    kept. A null doc_id comes before all others. Rows that repeat both doc_id
    and text count as one document and get equal results; an empty table stays
    empty; ids are cast to long. Other columns stay;
    ``n_lines``, ``n_removed`` and columns that begin with ``_`` are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed") and not c.startswith("_")]
    base = docs.select(*own, F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(text).alias("_hash"))
    narrow = _cut_up(base.select("_id", "_hash", F.col(text).alias("_text")), "_text")
    part = lambda c: F.slice(F.col("_lines"), _first(c) + 1, _last(c) - _first(c) + 1)
    worded = lambda c: F.size(F.filter(part(c), lambda x: F.btrim(x, F.lit(BLANK)) != "")) > 1
    # The lines stay behind when chunks become rows: a row with all of them for each chunk would be quadratic.
    each = F.explode(F.transform("_chunks", lambda c: F.struct(c.alias("c"), worded(c).alias("worded"), F.xxhash64(part(c)).alias("key"))))
    found = narrow.select("_id", "_hash", each.alias("_chunk")).where("_chunk.worded")
    found = shared.cut(found.select("_id", "_hash", F.col("_chunk.c").alias("_chunk"), F.col("_chunk.key").alias("_key")))

    twice = shared.cut(found.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1"))
    likely = shared.cut(shared.join_counted(found, twice, "_key", "n", "left_semi"))
    asked = likely.select("_id", "_hash", "_chunk").distinct()

    # Bytes against bytes: of equal chunks the least place is kept.
    # Neither side of the joins with documents has a bound, so they are merged at every size.
    whole = base.join(asked.groupBy("_id", "_hash").agg(F.collect_list("_chunk").alias("_asked")).hint("merge"), ["_id", "_hash"])
    whole = whole.select("_id", "_hash", F.split(F.col(text), "\n", -1).alias("_lines"), "_asked")
    each = F.explode(F.transform("_asked", lambda c: F.struct(c.alias("c"), _text(F.col("_lines"), c).alias("bytes"))))
    each = whole.select("_id", "_hash", each.alias("_chunk")).select("_id", "_hash", F.col("_chunk.c").alias("_chunk"), F.col("_chunk.bytes").alias("_bytes"))
    kept = each.groupBy("_bytes").agg(F.min(F.struct("_id", "_hash", "_chunk")).alias("k")).select("k.*")
    gone = asked.join(kept, ["_id", "_hash", "_chunk"], "left_anti").groupBy("_id", "_hash").agg(F.collect_list("_chunk").alias("_gone"))

    out = base.join(gone.hint("merge"), ["_id", "_hash"], "left")
    out = _cut_up(out, text).withColumn("_stay", F.array_except("_chunks", "_gone"))
    stay = F.array_join(F.transform("_stay", lambda c: _text(F.col("_lines"), c)), "\n")
    removed = F.aggregate("_gone", F.lit(0), lambda n, c: n + _last(c) - _first(c) + 1)
    new = F.struct(
        F.when(F.col("_gone").isNull(), F.col(text)).otherwise(stay).alias("text"),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long").alias("n_lines"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
    )
    # As the only row of an array, so that it is computed once, whatever a caller does with its fields.
    out = out.select(*(c for c in own if c != text), F.explode(F.array(new)).alias("_new"))
    return out.select(*((F.col("_new.text") if c == text else F.col(c)).alias(c) for c in own), "_new.n_lines", "_new.n_removed")
