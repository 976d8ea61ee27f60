"""From raw documents to packed training sequences, in four stages.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame that is written
as Parquet and read again as the next one's docs.  All but the last return the columns of documents.

All stages take null and empty texts (scored, compared and packed as empty, left as they are by pii), null and repeated
doc_ids, repeated rows, texts of any length and empty tables; what each does with them is stated at the operator it calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowgrid.llm import neardup, packing, pii, quality
from flowgrid.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the importance resampling draws stay, with all their columns; ties stay together.  Without labels of
    both kinds all stay."""
    return quality.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays, once; rows without a doc_id all stay.

    Groups are linked by a Jaccard similarity of 5-word shingles of 0.8 or more, after a check of the SimHash distance.
    """
    return neardup.representatives(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets; n_chars follows the new text; null texts stay null."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces of all rows in sequences of at most 4096 tokens; a null or empty text is one piece, the end id."""
    return packing.pack_texts(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: No SQL: models, tokenizers and the packing rule can't be expressed in it.  tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
