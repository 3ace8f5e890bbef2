"""The corpus pipeline: language ID, line deduplication, near-deduplication, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; ``run``
writes every stage's result as Parquet in the shared scratch folder and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import bagminhash, langid_crf, line_templates, packing
from quillspan.llm.common import materialize
from quillspan.llm.encoders import public_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words the CRF gives to learned languages with a mean certainty of a half or more; the rest goes."""
    return langid_crf.reject_unknown(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across documents."""
    return line_templates.drop_boilerplate(docs, counts=False)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies: the one with the smallest id."""
    return bagminhash.keep_one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences."""
    return packing.pack(docs, lambda: public_path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("packing", pack)]

#: A learned model and greedy packing are not expressible in SQL; the operators of the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
