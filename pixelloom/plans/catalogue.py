"""Registered queries of the image engine and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pixelloom.plans import codec_queries, filter_queries, pixel_queries, svg_queries, variant_queries  # noqa: F401
from pixelloom.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "entry"]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as images, over white, fitted and printed as ANSI rows."""
    return QUERIES["ansi_rows"](spark, sf_dir)
