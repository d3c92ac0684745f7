"""Corpus pipeline: quality, near duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of its predecessor and is
written as Parquet in the shared folder, which the next stage reads again. All but the
last return the columns that they get, whatever else these are called; an empty table
goes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import jaccard_join, line_quality, mixing, packing, pii
from scriptorium.llm.common import documents, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null, empty and very short texts go, each of several equal rows is judged alike."""
    return line_quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id: five-word shingles, Jaccard similarity 0.8 or more.

    Documents without words and rows with a null id stay; rows that repeat an id stay or go together.
    """
    return jaccard_join.keep_first(docs, width=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; n_chars follows the text, a null text stays null."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else clean


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in an order that interleaves their sources by weight; a null source counts as the source "", ties keep any order in their block."""
    return mixing.ordered(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2,048 ids; a null or empty text is the end id alone.

    Files are read again in any order, so the slots are derived again from the same documents: ranges of slots follow each other in the sequences.
    """
    _, slot = mixing.names_of(docs)
    made = packing.pack(mixing.mix(docs).repartitionByRange(slot).sortWithinPartitions(slot))
    return made.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("near duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Labelling by a trained field, and tokenizing, have no SQL form; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to the documents."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}")
    return docs
