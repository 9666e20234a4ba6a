"""The queries opN_<name> and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import bag_minhash, chat, exact_dedup, line_dedup, lm_scoring, mixing, packing, quality, repeats, token_store
from pixelloom.llm.blocks import bound_batches
from pixelloom.llm.common import spread, table
from pixelloom.llm.sql import ORACLE  # noqa: F401


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Python workers get bounded batches, whatever the length of texts.
    bound_batches(spark)
    return spread(table(spark, sf_dir, "documents"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(docs_of(spark, sf_dir))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(docs_of(spark, sf_dir), keep="max")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_plan(docs_of(spark, sf_dir))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bag_minhash.near_dedup(docs_of(spark, sf_dir))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(docs_of(spark, sf_dir)).select(*packing.PLACES)


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_store(docs_of(spark, sf_dir)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.lm_scores(docs_of(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.line_dedup(docs_of(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.repeated_substrings(docs_of(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_chats(rows))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_source_mixing": op3_source_mixing,
    "op4_bag_minhash": op4_bag_minhash,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_store": op6_token_store,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_line_dedup": op8_line_dedup,
    "op9_suffix_array_dedup": op9_suffix_array_dedup,
    "op10_chat_formatting": op10_chat_formatting,
}

