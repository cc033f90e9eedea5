"""A training-data pipeline over documents: each stage is one operator, written and read again before the next.

Each stage takes (spark, docs, folder), where docs is a table read from files,
and works on every row its predecessor kept. All but the last return the columns
of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import exact_dedup, ngram_join, packing, pii, toxicity
from casewright.llm.registry import table
from casewright.session import checkpoint_dir, lower_rows_at_once

# Documents that Python gets at once.
BATCH = 1024


def reject_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labelled rows of the whole table.

    Texts are scored when the stage is written, so the session's Arrow batch is
    lowered to ``BATCH`` rows from here on. That changes memory, not results.
    """
    lower_rows_at_once(spark, BATCH)
    model = toxicity.fit(table(spark, folder, "documents"), table(spark, folder, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each text, white space aside."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, words=5, percent=80)


def mask_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """All documents, with the kind of each span of personal data in its place, and n_chars as the text has them now."""
    return pii.mask(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens; workers remember less, as all stages share them."""
    return packing.pack(docs, memory=150_000)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

# The classifier, the linked groups and the packing cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    place = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, folder).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, folder)
