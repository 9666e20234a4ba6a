"""Two pixel tables into one: blending, compositing, merging, masks.

Each is an equi-join on (img, x, y) of tables partitioned alike, then one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import div
from pixelloom.operators.filters import RGB, RGBA, straight, unit

KEY = ["img", "x", "y"]


def beside(first: DataFrame, second: DataFrame) -> DataFrame:
    """Both tables' channels side by side, as 1r.. and 2r.. ."""

    def named(px: DataFrame, n: str) -> DataFrame:
        return px.select(*KEY, *(F.col(c).alias(n + c) for c in RGBA))

    return named(first, "1").join(named(second, "2"), KEY)


def blended(mode: str, s: Column, t: Column) -> Column:
    """Straight channels of the first (backdrop) and second input to the mixed one."""
    lifted = 1.0 - 2.0 * (1.0 - s) * (1.0 - t)
    if mode == "multiply":
        return s * t
    if mode == "screen":
        return 1.0 - (1.0 - s) * (1.0 - t)
    if mode == "darken":
        return F.least(s, t)
    if mode == "lighten":
        return F.greatest(s, t)
    if mode == "overlay":
        return F.when(s <= 0.5, 2.0 * s * t).otherwise(lifted)
    if mode == "hard-light":
        return F.when(t <= 0.5, 2.0 * s * t).otherwise(lifted)
    if mode == "soft-light":
        curve = F.when(s <= 0.25, ((16.0 * s - 12.0) * s + 4.0) * s).otherwise(F.sqrt(s))
        return F.when(t <= 0.5, s - (1.0 - 2.0 * t) * s * (1.0 - s)).otherwise(s + (2.0 * t - 1.0) * (curve - s))
    return t


def blend(first: DataFrame, second: DataFrame, mode: str = "normal") -> DataFrame:
    """The second input is the upper layer."""
    both = beside(first, second)
    s, t = straight("1"), straight("2")
    a1, a2 = s[3], t[3]
    out_a = a1 + a2 - a1 * a2
    channels = []
    for k, c in enumerate(RGB):
        p = F.col("1" + c) / 255.0 * (1.0 - a2) + F.col("2" + c) / 255.0 * (1.0 - a1) + blended(mode, s[k], t[k]) * a1 * a2
        plain = unit(F.when(out_a > 1e-6, p / out_a).otherwise(0.0))
        channels.append(F.round(F.round(plain * unit(out_a) * 255.0, 6)).cast("int").alias(c))
    return both.select(*KEY, *channels, F.round(F.round(unit(out_a) * 255.0, 6)).cast("int").alias("a"))


def composite(first: DataFrame, second: DataFrame, mode: str = "over", k: tuple[float, float, float, float] = (0, 0, 0, 0)) -> DataFrame:
    """Porter-Duff operators and the arithmetic one, on premultiplied values."""
    both = beside(first, second)
    a1, a2 = F.col("1a") / 255.0, F.col("2a") / 255.0
    weights = {"over": (1.0, 1.0 - a1), "in": (a2, 0.0), "out": (1.0 - a2, 0.0), "atop": (a2, 1.0 - a1), "xor": (1.0 - a2, 1.0 - a1)}
    out = []
    for c in RGBA:
        p, q = F.col("1" + c) / 255.0, F.col("2" + c) / 255.0
        if mode == "arithmetic":
            v = p * q * float(k[0]) + p * float(k[1]) + q * float(k[2]) + float(k[3])
        else:
            f, g = weights[mode]
            v = p * f + q * g
        out.append(F.round(F.round(unit(v) * 255.0, 6)).cast("int").alias(c))
    return both.select(*KEY, *out)


def source_over(below: DataFrame, above: DataFrame) -> DataFrame:
    """Premultiplied integer source-over, truncating, as bytes."""
    both = beside(below, above)
    inv = 255 - F.col("2a")
    return both.select(*KEY, *((F.col("2" + c) + div(F.col("1" + c) * inv, 255)).bitwiseAND(255).alias(c) for c in RGBA))


def merge(layers: list[DataFrame]) -> DataFrame:
    """Layers one over the other, the first at the bottom."""
    done = layers[0]
    for layer in layers[1:]:
        done = source_over(done, layer)
    return done


def luminance(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(54 * r + 183 * g + 19 * b + 128, 8)


def masked(px: DataFrame, mask: DataFrame) -> DataFrame:
    """Every channel scaled by the mask's luminance times its alpha, truncating."""
    both = beside(px, mask)
    level = div(luminance(F.col("2r"), F.col("2g"), F.col("2b")) * F.col("2a"), 255)
    return both.select(*KEY, *(div(F.col("1" + c) * level, 255).alias(c) for c in RGBA))


def palette_blit(canvas: DataFrame, indices: DataFrame, palette: DataFrame, transparent: int | None) -> DataFrame:
    """Colours of ``indices`` (img, x, y, idx) over the canvas; the transparent index and unknown ones leave it.

    The palette (idx, pr, pg, pb) has at most 256 rows, so it is broadcast.
    """
    shown = indices if transparent is None else indices.where(F.col("idx") != transparent)
    colored = shown.join(F.broadcast(palette), "idx").select(*KEY, "pr", "pg", "pb")
    joined = canvas.join(colored, KEY, "left")
    return joined.select(*KEY, *(F.coalesce("p" + c, c).alias(c) for c in RGB), F.when(F.col("pr").isNotNull(), 255).otherwise(F.col("a")).alias("a"))
