"""A corpus pipeline of four stages over the ``documents`` table.

Toxic documents go, one document of each class of near duplicates stays, documents that benchmark items leak into go, and
what is left is encoded. Each stage is written as Parquet and read again as the next one's input.

Rows without a key stay, as no stage can name them (unless their text is toxic). Null and empty texts are copies of each other, hold no benchmark item and have no
tokens; long ones are read whole. Of repeated rows, and of texts of a class, the one with the smallest key stays; different texts under one key are documents of
their own. Empty tables give empty tables. All stages but the last keep the columns as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumendex.llm import byte_bpe, common, decontaminate, jaccard_join, toxicity


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents that the classifier predicts to be toxic are rejected."""
    return toxicity.keep_clean(docs, common.table(spark, sf_dir, "labels"))


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each class of near duplicates the document with the smallest id stays."""
    return jaccard_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that a benchmark item leaks into are dropped."""
    return decontaminate.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: the byte-level BPE ids of each document, with digests of the ids and of what they decode to."""
    return byte_bpe.round_trip(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near duplicates", near_duplicates_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

#: The classifier and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.durable(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
