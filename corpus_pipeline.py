"""Corpus pipeline: quality, line, near-duplicate and substring filters, then packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. A stage's result is written as Parquet and read again by the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordlens.llm import lines, packing, quality, relz, simhash
from recordlens.llm.common import remove_folder, shared_folder


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold, with all their columns.

    Dictionaries and calibration come from the labelled rows of ``docs``. Null and empty texts have
    the score of no evidence; repeated rows stay or go together; no rows give no rows.
    """
    scorer = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, scorer)


def _resized(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns ``names``; ``n_chars``, if there, counts the text as it is now."""
    return docs.select(*[F.length("text").cast("long").alias(name) if name == "n_chars" else F.col(f"`{name}`") for name in names])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without recurring lines that an earlier document holds.

    Null texts stay null, emptied ones become empty; repeated rows lose the same lines; no rows give no rows.
    """
    return _resized(lines.drop_recurring_lines(docs), docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest doc_id.

    Null and empty texts are copies of each other; rows equal in doc_id and text stay together; a
    null doc_id goes if its group has another; no rows give no rows.
    """
    return simhash.keep_one(docs).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that start earlier.

    Null texts stay null; rows that repeat a doc_id and text lose the same words; no rows give no rows.
    """
    return _resized(relz.remove_repeats(docs), docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences.

    Null and empty texts are a piece of the end token alone; each repeated row has pieces of its own;
    no rows give no rows.
    """
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can express neither compression nor packing; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each one's result is a table in the session's shared folder until the next one's is written."""
    place = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            here = f"{place}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if last is not None:
                remove_folder(spark, last)
            last = here
    return docs
