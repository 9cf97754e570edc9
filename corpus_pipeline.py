"""Corpus pipeline: quality, repeated lines, near duplicates, benchmark passages, mixture; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm import byte_cnn, line_runs, mixing, order_minhash, tiling
from siftline.llm.common import new_path, read_table, remove


DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def _packed(docs: DataFrame) -> DataFrame:
    """docs with its further columns in one struct, so that no name of theirs clashes with what an operator adds."""
    more = [c for c in docs.columns if c not in DOCUMENT]
    return docs.select(*(c for c in docs.columns if c in DOCUMENT), F.struct(*more).alias("_further")) if more else docs


def _restored(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*(F.col(c) if c in DOCUMENT else F.col("_further")[c].alias(c) for c in docs.columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among docs.

    A null or empty text is judged as padding, rows that repeat a doc_id one by one, equal texts alike; without labels of both
    classes the model is constant and keeps all or none. No rows give none, further columns stay.
    """
    model = byte_cnn.fit(docs, read_table(spark, sf_dir, "labels"))
    return _restored(byte_cnn.score_quality(_packed(docs), model).where("predicted = 1"), docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; n_chars is counted anew.

    A null text becomes an empty one, rows that repeat a doc_id count as documents of their own, rows without one count and keep
    their lines; of several rows that tie on the largest doc_id of a line, each keeps it. No rows give none, further columns stay.
    """
    return _restored(line_runs.drop_repeated_lines(_packed(docs)).withColumn("n_chars", F.char_length("text").cast("long")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, that of the smallest doc_id.

    Null, empty and blank texts are classes of their own, of rows that repeat a doc_id one stays, rows without a doc_id stay, as
    whole texts of any length are compared. No rows give none, further columns stay.
    """
    return _restored(order_minhash.keep_one(_packed(docs)), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Null and empty texts are clean, null items match nothing, rows that repeat a doc_id are judged one by one, and equal texts
    alike; an empty benchmark leaves all documents. No rows give none, further columns stay.
    """
    return _restored(tiling.decontaminate(_packed(docs), read_table(spark, sf_dir, "benchmark")), docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: one row for each time a document is drawn, every document at least once.

    Null sources are one source, null and empty texts have no tokens and are drawn with their source's others, or once if it has
    no token at all; rows that repeat a doc_id are documents of their own, and tie in the permutation. No rows give none, other
    columns are left out.
    """
    return mixing.mix(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixture", mixture)]

#: The classifier and the near-duplicate classes are beyond SQL; tests hold run() against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents, each written as Parquet in the shared folder and read again.

    What a stage wrote is removed once the next one has been written; nulls, empty texts and tables, ties, repeated rows and
    further columns are treated as each stage says.
    """
    docs, before = read_table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = new_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
