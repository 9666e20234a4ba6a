"""Sample predictors and run-lengths as running sums and frame windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.functions.color import div


def undo_sub(df: DataFrame, by: list[str], order: str, value: str, modulus: int = 256) -> DataFrame:
    """Horizontal differencing undone: a running sum along each row, wrapped."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.pmod(F.sum(value).over(w), F.lit(modulus)).cast("int"))


def apply_sub(df: DataFrame, by: list[str], order: str, value: str, modulus: int = 256) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn(value, F.pmod(F.col(value) - F.coalesce(F.lag(value).over(w), F.lit(0)), F.lit(modulus)))


def adler32(df: DataFrame, by: str, at: str, byte: str) -> DataFrame:
    """Checksum of the bytes of each group; one map-side combinable aggregate."""
    n = F.count(F.lit(1))
    s1, s2 = F.sum(F.col(byte).cast("long")), F.sum(F.col(byte).cast("long") * F.col(at))
    a = (1 + s1) % 65521
    b = (n + n * s1 - s2) % 65521
    return df.groupBy(by).agg(n.alias("n"), (b * 65536 + a).alias("adler32"))


def static_zlib_size(df: DataFrame, by: str, byte: str) -> DataFrame:
    """Size of a zlib stream of literals in the fixed code: 8 bits below 144, else 9."""
    bits = F.sum(F.when(F.col(byte) < 144, 8).otherwise(9))
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), (6 + F.floor((3 + bits + 7 + 7) / 8)).alias("zlib_size"))


def last_drawn(frames: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """What each place of a canvas shows after every frame, where frames are kept and null draws nothing."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn(value, F.last(value, ignorenulls=True).over(w))


def start_times(frames: DataFrame, by: str, order: str, delay: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return frames.withColumn("start_ms", F.coalesce(F.sum(delay).over(w), F.lit(0)))


def ink_trim(ink: DataFrame, by: str, at: str, extent: int, share: int = 300) -> DataFrame:
    """Where to cut one axis of a page: bounds that leave ``1/share`` of the ink outside on each side.

    ``ink`` has one row per inked pixel. At most a sixth of the extent goes on a side, and 16 places stay as padding.
    """
    counts = ink.groupBy(by, at).agg(F.count(F.lit(1)).alias("n"))
    up = Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    sums = counts.withColumns({"upto": F.sum("n").over(up), "total": F.sum("n").over(whole)})
    cut = div(F.col("total"), share)
    bounds = sums.groupBy(by).agg(
        F.min(F.when(F.col("upto") > cut, F.col(at))).alias("low"),
        F.min(F.when(F.col("upto") >= F.col("total") - cut, F.col(at))).alias("high"),
    )
    sixth = extent // 6
    return bounds.select(
        by,
        F.greatest(F.lit(0), F.least(F.col("low"), F.lit(sixth)) - 16).alias("low"),
        F.least(F.lit(extent - 1), F.greatest(F.col("high"), F.lit(extent - 1 - sixth)) + 16).alias("high"),
    )


def run_lengths(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Gaps and islands: (by..., first, value, n) of each run of equal values."""
    w = Window.partitionBy(*by).orderBy(order)
    opens = (~F.coalesce(F.lag(value).over(w) == F.col(value), F.lit(False))).cast("int")
    numbered = df.withColumn("__opens", opens).withColumn("__run", F.sum("__opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__run").agg(F.min(order).alias("first"), F.first(value).alias(value), F.count(F.lit(1)).alias("n")).drop("__run")


def packed_sum(columns: list[Column]) -> Column:
    return sum(columns, F.lit(0))
