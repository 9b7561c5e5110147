"""A corpus pipeline: clean, deduplicate, mix and encode documents.

Every stage works on rows, not on ids: rows that repeat an id, or have none, are decided each by their
own text. Extra columns of documents come along through all stages but the last, whatever their names.
An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm.common import bound_batches, stage, table
from quarry.llm.exact_dedup import keep_first
from quarry.llm.mixing import take_copies
from quarry.llm.neardup import keep_one
from quarry.llm.sentencepiece import encode_documents, model_path
from quarry.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows predicted toxic go. Null and empty texts stay; repeated rows stay or go together."""
    bound_batches(spark)
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays, the one with the least id; null and empty texts are one group."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (five words, 0.8) stays, the one with the least id; rows without words are in no group and stay."""
    bound_batches(spark)
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their source's target asks, from none to three times; rows without words once. A null source is a source."""
    return take_copies(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, round_trip, parity, ids of each copy; a null or empty text has no ids."""
    bound_batches(spark)
    return encode_documents(docs, model_path(), verify=True)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("encoding", encoding)]

#: SQL can't express the first stage; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read back."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, f"pipeline-{name}")
    return docs
