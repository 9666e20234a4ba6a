"""A training corpus from raw documents: filter, clean, deduplicate, mix, pack.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept,
and returns a DataFrame that is written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm import bag_minhash, blocks, line_dedup, mixing, packing, quality
from pixelloom.llm.common import spread, stage, words_of


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document that held nothing else."""
    dropped = "__n_dropped"
    cleaned = line_dedup.line_dedup(docs, figures=("__n_lines", dropped))
    left = (F.col(dropped) == 0) | (F.size(words_of(F.col("text"))) > 0)
    return cleaned.where(left).withColumn("n_chars", F.length("text").cast("long")).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    kept = bag_minhash.near_dedup(docs).where("kept").select(F.col("doc_id").alias("kept_id"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["kept_id"]), "left_semi")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and their places in sequences of 1024."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", lines),
    ("near-dedup", near_duplicates),
    ("source mixing", source_mix),
    ("best-fit packing", packed),
]

#: Edit joins, MinHash classes and tokenizers are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``: the places of the last one's pieces, whose ids are in its files."""
    blocks.bound_batches(spark)
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for k, (_, step) in enumerate(STAGES):
        docs = stage(step(spark, docs, sf_dir), f"stage-{k}")
    return docs.select(*packing.PLACES)
