"""Resampling: fitting to a cell grid, supersample resolve, coordinate remaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import div, over_white

SAMPLES = 4


def fitted_size(w: Column, h: Column, max_width: int, max_height: int) -> tuple[Column, Column]:
    """Output width and height: only ever smaller, both by one scale, at least 1x1."""
    scale = F.lit(1.0)
    if max_width > 0:
        scale = F.least(scale, F.lit(float(max_width)) / w)
    if max_height > 0:
        scale = F.least(scale, F.lit(float(max_height)) / h)
    return tuple(F.greatest(F.lit(1), F.floor(v * scale).cast("int")) for v in (w, h))


def fit(px: DataFrame, max_width: int, max_height: int, size: tuple[int, int] | None = None) -> DataFrame:
    """(img, x, y, r, g, b) of at most so many cells, over white.

    When shrinking, a cell is the truncated mean of 4x4 point samples. Each source row
    and column serves whole samples, so a pixel knows from its own place how many
    samples of which cells fall on it; cells then add up weights. One shuffle, no join.
    """
    from pixelloom.operators.filters import sized

    known = sized(px, size)
    out_w, out_h = fitted_size(F.col("w").cast("double"), F.col("h").cast("double"), max_width, max_height)
    known = known.withColumns({"ow": out_w, "oh": out_h})
    white = {c: over_white(F.col(c), F.col("a")) for c in "rgb"}

    def served(at: str, n: str, out: str) -> Column:
        """Cells of one axis that sample this place, with the number of samples."""
        low = F.greatest(F.lit(0), F.floor(F.col(at) * F.col(out) / F.col(n)).cast("int") - 1)
        high = F.least(F.col(out) - 1, F.floor((F.col(at) + 1) * F.col(out) / F.col(n)).cast("int") + 1)

        def hits(cell: Column) -> Column:
            p0 = cell.cast("double") * F.col(n).cast("double") / F.col(out).cast("double")
            p1 = (cell + 1).cast("double") * F.col(n).cast("double") / F.col(out).cast("double")
            places = [F.least(F.col(n) - 1, F.floor(p0 + F.lit(s + 0.5) * (p1 - p0) / F.lit(float(SAMPLES))).cast("int")) for s in range(SAMPLES)]
            return sum(((p == F.col(at)).cast("int") for p in places), F.lit(0))

        cells = F.transform(F.sequence(low, high), lambda c: F.struct(c.alias("c"), hits(c).alias("n")))
        return F.filter(cells, lambda s: s["n"] > 0)

    spread = known.withColumns(white).withColumn("cx", F.explode(served("x", "w", "ow"))).withColumn("cy", F.explode(served("y", "h", "oh")))
    weight = F.col("cx.n") * F.col("cy.n")
    return spread.groupBy("img", F.col("cx.c").alias("x"), F.col("cy.c").alias("y")).agg(
        *(div(F.sum(F.col(c) * weight), SAMPLES * SAMPLES).alias(c) for c in "rgb")
    )


def resolve(px: DataFrame, ss: int) -> DataFrame:
    """Box mean of ss x ss premultiplied pixels, then straight colour; all truncating."""
    cells = px.groupBy("img", div(F.col("x"), ss).alias("x"), div(F.col("y"), ss).alias("y")).agg(
        *(div(F.sum(c), ss * ss).alias(c) for c in "rgba")
    )
    straight = {c: F.when(F.col("a") > 0, div(F.col(c) * 255, F.col("a")).bitwiseAND(255)).otherwise(0) for c in "rgb"}
    return cells.withColumns(straight)


def orient(px: DataFrame, orientation: int, size: tuple[int, int] | None = None) -> DataFrame:
    """TIFF orientations 1..8 as a remap of coordinates; 5 to 8 swap the axes."""
    from pixelloom.operators.filters import sized

    x, y, right, bottom = F.col("x"), F.col("y"), F.col("w") - 1 - F.col("x"), F.col("h") - 1 - F.col("y")
    places = {1: (x, y), 2: (right, y), 3: (right, bottom), 4: (x, bottom), 5: (y, x), 6: (bottom, x), 7: (bottom, right), 8: (y, right)}
    nx, ny = places[orientation]
    return sized(px, size).select("img", nx.alias("x"), ny.alias("y"), "r", "g", "b", "a")


def deinterlaced_row(row: Column, height: Column) -> Column:
    """The place of the row-th stored row of a GIF's four passes."""
    n1, n2, n3 = div(height + 7, 8), div(height + 3, 8), div(height + 1, 4)
    return (
        F.when(row < n1, row * 8)
        .when(row < n1 + n2, (row - n1) * 8 + 4)
        .when(row < n1 + n2 + n3, (row - n1 - n2) * 4 + 2)
        .otherwise((row - n1 - n2 - n3) * 2 + 1)
    )
