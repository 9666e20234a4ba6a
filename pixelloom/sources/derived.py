"""Pixel and byte tables derived from ordinary tables, for queries and tests.

An embedding of 64 numbers is a 4x4 RGBA image; a document's text is a byte stream;
line items make long one-row images, a row per supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_byte(v: Column) -> Column:
    """Spread -0.4..0.4 over 0..255, clamped."""
    scaled = F.floor((v.cast("double") + F.lit(0.4)) / F.lit(0.8) * F.lit(255)).cast("int")
    return F.least(F.lit(255), F.greatest(F.lit(0), scaled))


def emb_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, x, y, r, g, b, a): sixteen pixels of each embedding."""
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("img"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("p")
    )
    channel = [to_byte(F.element_at("embedding", F.col("p") * 4 + k)).alias(c) for k, c in enumerate("rgba", 1)]
    return rows.select("img", (F.col("p") % 4).alias("x"), F.floor(F.col("p") / 4).cast("int").alias("y"), *channel)


def premultiplied(px: DataFrame) -> DataFrame:
    """Straight to premultiplied colour, truncating."""
    scaled = {c: F.expr(f"cast({c} * a div 255 as int)") for c in "rgb"}
    return px.withColumns(scaled)


def doc_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, b): every byte of every text's UTF-8, by position."""
    # Read as Latin-1, a byte is a character, and a character's code is the byte.
    chars = F.split(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), "")
    docs = table(spark, sf_dir, "documents").where(F.length("text") > 0).select("doc_id", F.posexplode(chars).alias("i", "c"))
    return docs.select("doc_id", "i", F.ascii("c").alias("b"))


def line_px(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(img, seq, r, g, b, a) from line items: img is the supplier, seq a position without gaps or ties."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("img"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        (F.col("l_quantity").cast("long") * 5 % 256).cast("int").alias("r"),
        (F.round(F.col("l_discount") * 100).cast("long") * 25 % 256).cast("int").alias("g"),
        (F.round(F.col("l_tax") * 100).cast("long") * 31 % 256).cast("int").alias("b"),
        (F.floor("l_extendedprice").cast("long") % 256).cast("int").alias("a"),
    )
