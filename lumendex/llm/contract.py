"""The registered queries: thin, each over its operator and its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat, common, decontaminate, jaccard_join, oracles, prefix_counts, token_files, topk, toxicity, url_filter, warc

Query = Callable[[SparkSession, str], DataFrame]


#: The contract's rules.
RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(common.table(spark, sf_dir, "pages"), RULES)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(common.table(spark, sf_dir, "documents"))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").where(F.col("vec_id").isNotNull() & topk.usable("embedding"))
    vectors = rows.select(F.col("vec_id").cast("bigint").alias("id"), topk.quantised("embedding", 256).alias("v"))
    return topk.exact_topk(vectors.where(F.col("id") % 50 == 0), vectors, k=5)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(common.table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "matched")


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text")
    )
    return chat.digests(chat.read_back(chat.windows(turns.unionByName(extra))))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "warc")
    warc.write(common.table(spark, sf_dir, "pages"), path)
    records = warc.read(spark, path).where(F.col("gap_reason").isNull())
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_counts.count_tokens(common.table(spark, sf_dir, "documents"), limit=2048)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.fresh_path(spark, "token-files")
    token_files.write(common.table(spark, sf_dir, "documents"), path, end_id=2)
    return token_files.read(spark, path)


QUERIES: dict[str, Query] = {
    "op1_url_filters": op1_url_filters,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_exact_topk": op3_exact_topk,
    "op4_toxicity": op4_toxicity,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_token_files": op10_token_files,
}
ORACLES: dict[str, str] = oracles.ORACLES
