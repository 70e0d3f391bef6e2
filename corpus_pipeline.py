"""The corpus pipeline: documents are judged, cut, deduplicated, decontaminated and encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; all but the last return the columns of ``documents``. Between stages
the documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexspark.llm import decontam, lines, minhash, pieces, quality
from plexspark.llm.shared import cut, drop, scratch, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the counts or the compression bands reject go, null and empty texts among them.

    Rows are judged one by one: repeated ones go or stay together, null ids don't matter.
    """
    return quality.quality(docs).where("quality.kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut out of texts; a text of which nothing is left goes, and so does a null one.

    An empty text of the input stays; rows that repeat doc_id and text count as one document and keep the same.
    """
    out = lines.dedup_lines(docs)
    left = (F.col("n_removed") == 0) | (F.btrim("text", F.lit(lines.BLANK)) != "")
    return out.where(F.col("text").isNotNull() & left).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays: that of the smallest doc_id.

    Rows that repeat that doc_id are copies too: the text that comes first stays, once. Null ids come
    last; texts without words, null ones too, are in no group and stay.
    """
    kept = minhash.first_of_groups(docs, size=5, percent=80)
    return kept.select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark, up to a fifth of its words, go.

    Rows are judged by their own text, whatever their ids; null and empty texts hold nothing and stay.
    """
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"), edits=0.2).select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, with merge-dropout; they decode to the text.

    A null text has null ids and an empty one none; rows that repeat doc_id and text get equal ids. In
    every stage an empty table stays empty.
    """
    out = pieces.encode_documents(docs, rate=0.1, seed=1)
    return out.select("doc_id", "lang", "source", F.size("pieces.ids").cast("long").alias("n_pieces"), F.col("pieces.ids").alias("ids"), F.col("pieces.round_trip").alias("round_trip"))


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("SentencePiece encoding", encoding)]

#: Compression ratios, sketches and pieces are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        with scratch() as keep:  # what a stage wrote for itself goes with it
            before, docs = docs, stage(spark, docs, sf_dir)
            if n + 1 < len(STAGES):
                docs = keep(cut(docs))
        if n + 1 < len(STAGES):
            drop(before)
    return docs
