"""A training corpus from documents: quality rules, exact and near deduplication, masking of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents; the last returns one row per packed piece. A null text counts as empty throughout; an empty
table passes through every stage as an empty table. Of rows that are equal in text one stays, the largest doc_id, and of rows
equal in doc_id and text one of them; of near copies the smallest doc_id stays. Very long texts are read whole in every
stage. Columns that documents do not have are kept by all stages but the last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelspark.llm import exact_dedup, near_dedup, packing, pii, quality
from pixelspark.llm.common import stash, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.keep_good(docs)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (A-Z lower-cased), the row with the largest doc_id."""
    return exact_dedup.drop_duplicates(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles with a similarity of 0.8 or more, the one with the smallest doc_id."""
    return near_dedup.drop_near_duplicates(docs, 5)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked; n_chars follows the text."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and offset."""
    return packing.pack_documents(docs, packing.word_bpe_path())


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_deduplication), ("near dedup", near_deduplication), ("personal data", personal_data), ("packing", packed_sequences)]

#: Near duplicates, trained spans and packing have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
