"""ANSI text: one background-coloured space per cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ESC = "\x1b"


def ansi_rows(cells: DataFrame) -> DataFrame:
    """(img, y, line) of fitted cells (img, x, y, r, g, b). A colour is set where it changes in a row."""
    row = Window.partitionBy("img", "y").orderBy("x")
    color = F.struct("r", "g", "b")
    same = F.coalesce(F.lag(color).over(row) == color, F.lit(False))
    escape = F.concat(F.lit(f"{ESC}[48;2;"), F.col("r"), F.lit(";"), F.col("g"), F.lit(";"), F.col("b"), F.lit("m"))
    cell = F.concat(F.when(same, F.lit("")).otherwise(escape), F.lit(" "))
    parts = cells.select("img", "y", "x", cell.alias("cell"))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x", "cell"))), lambda c: c["cell"]), "")
    return parts.groupBy("img", "y").agg(F.concat(line, F.lit(f"{ESC}[0m\n")).alias("line"))


def ansi_text(cells: DataFrame) -> DataFrame:
    """(img, text): the rows of each image joined."""
    rows = ansi_rows(cells).groupBy("img").agg(F.sort_array(F.collect_list(F.struct("y", "line"))).alias("rows"))
    return rows.select("img", F.array_join(F.transform("rows", lambda r: r["line"]), "").alias("text"))
