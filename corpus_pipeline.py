"""A training-data pipeline in five stages; each is written as Parquet and read again as the next one's documents.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, and
further columns of any name.  A null text counts as empty in every stage and stays null; rows without a doc_id, with
a repeated one, and repeated rows are judged as the rows they are; an empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesieve.llm import decontaminate, near_dup, packing, pii, quality
from framesieve.llm.common import discard, fold, scratch, shared_dir, table
from framesieve.llm.queries import tokenizer_path


def _packed(docs: DataFrame) -> DataFrame:
    """Rows as (row, text), so that no column of theirs meets one that an operator makes."""
    return docs.select(F.struct(*docs.columns).alias("row"), "text")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.3); it learns from the labelled ones among docs.
    Null, empty and blank texts all score the model's bias, and stay or go together; equal texts do so too."""
    weights = quality.train(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return quality.classify(_packed(docs), weights, ["row"]).where("predicted = 1").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the row of the smallest doc_id, a null one last, and of several such
    rows one.  Null, empty and blank texts are one class."""
    return near_dup.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none."""
    found = decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark"), ["row"])
    return found.where("size(matches) = 0").select("row.*")


def pii_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with identifiers replaced by their kinds."""
    return pii.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their sequence and offset there; a null or empty text is one piece of
    one token."""
    return packing.pack(docs, tokenizer_path(), ["doc_id"], with_ids=False)


STAGES = [
    ("quality", quality_filter),
    ("near_dup", near_duplicates),
    ("decontaminate", decontamination),
    ("pii", pii_redaction),
    ("packing", best_fit_packing),
]

#: A fitted model and a bootstrap over the corpus have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark).rstrip('/')}/framesieve-{name}-{uuid.uuid4().hex}"
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if name != STAGES[0][0]:
            discard(docs)
        docs = spark.read.parquet(path)
    return docs
