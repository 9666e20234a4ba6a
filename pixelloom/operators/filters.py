"""SVG filter primitives over pixel tables (img, x, y, r, g, b, a), premultiplied.

Neighbourhoods are kernels of a few constants: a pixel is sent to the cells it
touches by exploding a literal array, and cells aggregate what they get. That is one
shuffle on (img, y, x) with partial sums, and no join. Separable and rectangular
neighbourhoods use frame windows instead.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RGB = ("r", "g", "b")
RGBA = (*RGB, "a")


def to_byte(v: Column) -> Column:
    """Clamp to 0..255 and round half away from zero."""
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")


def unit(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def extent(px: DataFrame) -> DataFrame:
    """(img, w, h) of each image."""
    return px.groupBy("img").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def sized(px: DataFrame, size: tuple[int, int] | None) -> DataFrame:
    """``px`` with w and h: constants if all images have one size, else by window."""
    if size:
        return px.withColumns({"w": F.lit(size[0]), "h": F.lit(size[1])})
    by = Window.partitionBy("img")
    return px.withColumns({"w": F.max("x").over(by) + 1, "h": F.max("y").over(by) + 1})


def gaussian_kernel(sigma: float) -> list[float]:
    """Normalised weights -radius..radius; radius is 3 sigma rounded up, from 1 to 96."""
    radius = min(96, max(1, math.ceil(3 * sigma)))
    s = min(sigma, radius / 3)
    raw = [math.exp(-0.5 * i * i / (s * s)) for i in range(-radius, radius + 1)]
    return [v / sum(raw) for v in raw]


def blur_axis(px: DataFrame, axis: str, sigma: float, size: tuple[int, int] | None) -> DataFrame:
    """One pass of the blur; outside an image its edge pixel counts."""
    if sigma < 0.01:
        return px
    kernel = gaussian_kernel(sigma)
    radius = len(kernel) // 2
    limit = "w" if axis == "x" else "h"
    at, last = F.col(axis), F.col(limit) - 1
    taps = F.array(*(F.struct(F.lit(k - radius).alias("k"), F.lit(v).alias("v")) for k, v in enumerate(kernel)))
    # Target t reads clamp(t + k). Away from the edges that is t = at - k; edge pixels also serve targets further in.
    near = F.transform(taps, lambda p: F.struct((at - p["k"]).alias("t"), p["v"].alias("v")))
    low = F.flatten(
        F.transform(
            F.filter(taps, lambda p: p["k"] < 0),
            lambda p: F.transform(F.sequence(F.lit(1), -p["k"]), lambda d: F.struct((-d - p["k"]).alias("t"), p["v"].alias("v"))),
        )
    )
    high = F.flatten(
        F.transform(
            F.filter(taps, lambda p: p["k"] > 0),
            lambda p: F.transform(F.sequence(F.lit(1), p["k"]), lambda d: F.struct((last + d - p["k"]).alias("t"), p["v"].alias("v"))),
        )
    )
    none = F.array().cast("array<struct<t:int,v:double>>")
    hits = F.concat(near, F.when(at == 0, low).otherwise(none), F.when(at == last, high).otherwise(none))
    hits = F.filter(hits, lambda h: (h["t"] >= 0) & (h["t"] <= last))
    spread = sized(px, size).withColumn("hit", F.explode(hits))
    target = F.col("hit.t").alias(axis)
    other = "y" if axis == "x" else "x"
    sums = [to_byte(F.round(F.sum(F.col(c) * F.col("hit.v")), 6)).alias(c) for c in RGBA]
    return spread.groupBy("img", other, target).agg(*sums).select("img", "x", "y", *RGBA)


def gaussian_blur(px: DataFrame, sigma_x: float, sigma_y: float, size: tuple[int, int] | None = None) -> DataFrame:
    return blur_axis(blur_axis(px, "x", sigma_x, size), "y", sigma_y, size)


def offset(px: DataFrame, dx: int, dy: int) -> DataFrame:
    """Shift; what comes in from outside is transparent."""
    moved = px.select("img", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), *RGBA)
    grid = px.select("img", "x", "y")
    return grid.join(moved, ["img", "x", "y"], "left").fillna(0, list(RGBA))


def straight(prefix: str = "") -> tuple[Column, ...]:
    """Unpremultiplied channels as doubles in 0..1, and alpha."""
    a = F.col(prefix + "a") / 255.0
    return (*(F.when(a > 0, F.col(prefix + c) / 255.0 / a).otherwise(F.lit(0.0)) for c in RGB), a)


def packed(r: Column, g: Column, b: Column, a: Column) -> list[Column]:
    """Premultiplied bytes of straight channels in 0..1."""
    return [
        *(F.round(F.round(c * a * 255.0, 6)).cast("int").alias(n) for n, c in zip(RGB, (r, g, b))),
        F.round(F.round(a * 255.0, 6)).cast("int").alias("a"),
    ]


def saturate(s: float) -> list[float]:
    r, g, b = 0.213, 0.715, 0.072
    rows = [[r + s * (1 - r), g - s * g, b - s * b], [r - s * r, g + s * (1 - g), b - s * b], [r - s * r, g - s * g, b + s * (1 - b)]]
    return [*rows[0], 0, 0, *rows[1], 0, 0, *rows[2], 0, 0, 0, 0, 0, 1, 0]


def hue_rotate(degrees: float) -> list[float]:
    r, g, b = 0.213, 0.715, 0.072
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    rows = [
        [r + c * (1 - r) - s * r, g - c * g - s * g, b - c * b + s * (1 - b)],
        [r - c * r + s * 0.143, g + c * (1 - g) + s * 0.140, b - c * b - s * 0.283],
        [r - c * r - s * (1 - r), g - c * g + s * g, b + c * (1 - b) + s * b],
    ]
    return [*rows[0], 0, 0, *rows[1], 0, 0, *rows[2], 0, 0, 0, 0, 0, 1, 0]


LUMINANCE_TO_ALPHA = [0.0] * 15 + [0.2126, 0.7152, 0.0722, 0.0, 0.0]


def color_matrix(px: DataFrame, matrix: Sequence[float]) -> DataFrame:
    """A 4x5 matrix on straight colour."""
    source = straight()
    out = [unit(sum((v * float(m) for v, m in zip(source, matrix[k : k + 4])), F.lit(float(matrix[k + 4])))) for k in range(0, 20, 5)]
    return px.select("img", "x", "y", *packed(*out))


def transfer(v: Column, kind: str, *, table: Sequence[float] = (), slope=1.0, intercept=0.0, amplitude=1.0, exponent=1.0, offset=0.0) -> Column:
    """A transfer function on a channel in 0..1."""
    v = unit(v)
    if kind in ("table", "discrete") and len(table):
        steps = F.array(*(F.lit(float(t)) for t in table))
        n = len(table)
        if kind == "discrete":
            out = F.get(steps, F.least(F.floor(v * float(n)).cast("int"), F.lit(n - 1)))
        else:
            t = v * float(n - 1)
            i = F.floor(t).cast("int")
            low, high = F.get(steps, i), F.get(steps, F.least(i + 1, F.lit(n - 1)))
            out = low + (high - low) * (t - i)
    elif kind == "linear":
        out = v * slope + intercept
    elif kind == "gamma":
        out = F.pow(v, F.lit(exponent)) * amplitude + offset
    else:
        out = v
    return unit(out)


def component_transfer(px: DataFrame, **functions) -> DataFrame:
    """``functions`` maps a channel to (kind, options); channels left out stay as they are."""
    out = []
    for name, v in zip(RGBA, straight()):
        kind, options = functions.get(name, ("identity", {}))
        out.append(transfer(v, kind, **options))
    return px.select("img", "x", "y", *packed(*out))


def convolve(
    px: DataFrame,
    kernel: Sequence[Sequence[float]],
    *,
    target: tuple[int, int] | None = None,
    divisor: float = 1.0,
    bias: float = 0.0,
    edge: str = "duplicate",
    preserve_alpha: bool = False,
    size: tuple[int, int] | None = None,
) -> DataFrame:
    """A matrix over each pixel's neighbourhood, not rotated. Outside: duplicate, wrap or none."""
    oy, ox = len(kernel), len(kernel[0])
    tx, ty = target or (ox // 2, oy // 2)
    taps = [(kx - tx, ky - ty, float(kernel[ky][kx])) for ky in range(oy) for kx in range(ox)]
    tap = F.explode(F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy"), F.lit(k).alias("k")) for a, b, k in taps)))
    cells = sized(px, size).select("img", "x", "y", "w", "h", "a", tap.alias("t"))
    sx, sy = F.col("x") + F.col("t.dx"), F.col("y") + F.col("t.dy")
    if edge == "duplicate":
        sx = F.greatest(F.lit(0), F.least(F.col("w") - 1, sx))
        sy = F.greatest(F.lit(0), F.least(F.col("h") - 1, sy))
    elif edge == "wrap":
        sx, sy = F.pmod(sx, F.col("w")), F.pmod(sy, F.col("h"))
    cells = cells.select("img", "x", "y", F.col("a").alias("own"), F.col("t.k").alias("k"), sx.alias("sx"), sy.alias("sy"))
    source = px.select("img", F.col("x").alias("sx"), F.col("y").alias("sy"), *RGBA)
    joined = cells.join(source, ["img", "sx", "sy"], "left")
    d = 1.0 if abs(divisor) < 1e-6 else divisor
    sums = {c: F.coalesce(F.sum(F.col(c) * F.col("k")), F.lit(0.0)) / d + bias * 255.0 for c in RGBA}
    if preserve_alpha:
        own = F.max("own")
        out = [*(to_byte(F.round(sums[c] * (own / 255.0) / 255.0, 6)).alias(c) for c in RGB), own.alias("a")]
    else:
        out = [to_byte(F.round(v, 6)).alias(c) for c, v in sums.items()]
    return joined.groupBy("img", "x", "y").agg(*out)


def noise_hash(x: Column, y: Column, seed: int) -> Column:
    """A 32-bit mixing hash of a grid point; products wrap as unsigned 32-bit numbers do."""
    full = F.lit(4294967295).cast("long")
    h = (x.cast("long") * 374761393 + y.cast("long") * 668265263).bitwiseAND(full).bitwiseXOR(F.lit(seed).cast("long"))
    h = (h.bitwiseXOR(F.shiftright(h, 13)) * 1274126177).bitwiseAND(full)
    return h.bitwiseXOR(F.shiftright(h, 16))


def value_noise(x: Column, y: Column, seed: int) -> Column:
    """Smoothly interpolated hash values, -1..1."""
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    u, v = fx * fx * (3.0 - 2.0 * fx), fy * fy * (3.0 - 2.0 * fy)
    corner = [[noise_hash(x0 + i, y0 + j, seed).bitwiseAND(65535) / 65535.0 for i in (0, 1)] for j in (0, 1)]
    top = corner[0][0] + (corner[0][1] - corner[0][0]) * u
    bottom = corner[1][0] + (corner[1][1] - corner[1][0]) * u
    return (top + (bottom - top) * v) * 2.0 - 1.0


def turbulence(px: DataFrame, freq_x: float, freq_y: float, octaves: int = 1, seed: int = 0, fractal: bool = False) -> DataFrame:
    """Grey noise over the grid of ``px``, opaque."""
    total, amp, reach = F.lit(0.0), 1.0, 0.0
    for o in range(max(1, octaves)):
        n = value_noise(F.col("x") * (freq_x * 2**o), F.col("y") * (freq_y * 2**o), seed + 17 * o)
        total = total + (n if fractal else F.abs(n)) * amp
        reach += amp
        amp /= 2
    value = total / reach * 0.5 + 0.5 if fractal else total / reach
    grey = F.round(F.round(unit(value) * 255.0, 6)).cast("int")
    return px.select("img", "x", "y", *(grey.alias(c) for c in RGB), F.lit(255).alias("a"))


def displacement(px: DataFrame, by: DataFrame, scale: float, x_channel: str = "r", y_channel: str = "g", size: tuple[int, int] | None = None) -> DataFrame:
    """Each pixel reads from where two channels of ``by`` point."""

    def channel(name: str) -> Column:
        return straight()[RGBA.index(name)]

    moves = sized(by, size).select(
        "img",
        "x",
        "y",
        F.greatest(F.lit(0), F.least(F.col("w") - 1, F.round(F.col("x") + (channel(x_channel) - 0.5) * scale).cast("int"))).alias("sx"),
        F.greatest(F.lit(0), F.least(F.col("h") - 1, F.round(F.col("y") + (channel(y_channel) - 0.5) * scale).cast("int"))).alias("sy"),
    )
    source = px.select("img", F.col("x").alias("sx"), F.col("y").alias("sy"), *RGBA)
    return moves.join(source, ["img", "sx", "sy"]).select("img", "x", "y", *RGBA)


def lighting(
    px: DataFrame,
    light: tuple[float, float, float],
    color: tuple[int, int, int],
    *,
    surface_scale: float = 1.0,
    constant: float = 1.0,
    exponent: float | None = None,
) -> DataFrame:
    """Diffuse lighting of the alpha surface, or specular if an exponent is given; a distant light."""
    length = math.sqrt(sum(v * v for v in light))
    lx, ly, lz = (v / length for v in light) if length > 1e-6 else (0.0, 0.0, 1.0)
    row = Window.partitionBy("img", "y").orderBy("x")
    col = Window.partitionBy("img", "x").orderBy("y")
    alpha = F.col("a") / 255.0
    # Sobel is separable: smooth and difference along x, then the other way along y.
    edge = px.withColumns({"al": alpha, "before": F.coalesce(F.lag(alpha).over(row), alpha), "after": F.coalesce(F.lead(alpha).over(row), alpha)})
    edge = edge.withColumns({"dx": F.col("after") - F.col("before"), "sx": F.col("before") + 2.0 * F.col("al") + F.col("after")})

    def above(c: str) -> Column:
        return F.coalesce(F.lag(c).over(col), F.col(c))

    def below(c: str) -> Column:
        return F.coalesce(F.lead(c).over(col), F.col(c))

    gx = above("dx") + 2.0 * F.col("dx") + below("dx")
    gy = below("sx") - above("sx")
    slope = edge.withColumns({"nx": -gx * surface_scale, "ny": -gy * surface_scale})
    norm = F.sqrt(F.col("nx") * F.col("nx") + F.col("ny") * F.col("ny") + 1.0)
    dot = (F.col("nx") * lx + F.col("ny") * ly + lz) / norm
    if exponent is None:
        power = F.when(dot > 0, dot * constant).otherwise(0.0)
        out_a, level = alpha, unit(power)
    else:
        reflected = 2.0 * dot / norm - lz
        power = F.when((dot > 0) & (reflected > 0), F.pow(F.greatest(reflected, F.lit(0.0)), F.lit(exponent)) * constant).otherwise(0.0)
        out_a, level = alpha * unit(power), F.lit(1.0)
    channels = [to_byte(F.round(F.lit(c / 255.0) * level * out_a * 255.0, 6)).alias(n) for n, c in zip(RGB, color)]
    return slope.select("img", "x", "y", *channels, to_byte(F.round(out_a * 255.0, 6)).alias("a"))


def flood(px: DataFrame, color: tuple[int, int, int, int]) -> DataFrame:
    """A constant colour, given straight, premultiplied and truncated."""
    r, g, b, a = color
    return px.select("img", "x", "y", *(F.lit(c * a // 255).alias(n) for n, c in zip(RGB, (r, g, b))), F.lit(a).alias("a"))


def morphology(px: DataFrame, rx: int, ry: int, dilate: bool) -> DataFrame:
    """Largest or smallest value of each channel in a box, clipped at the edges."""
    best = F.max if dilate else F.min
    row = Window.partitionBy("img", "y").orderBy("x").rowsBetween(-rx, rx)
    col = Window.partitionBy("img", "x").orderBy("y").rowsBetween(-ry, ry)
    wide = px.select("img", "x", "y", *(best(c).over(row).alias(c) for c in RGBA))
    return wide.select("img", "x", "y", *(best(c).over(col).alias(c) for c in RGBA))


def tile(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    """Repeat a region over itself, modulo its size, and clear the rest."""
    return region_clip(px, x0, y0, x1, y1)


def region_clip(px: DataFrame, x0: int, y0: int, x1: int, y1: int) -> DataFrame:
    inside = F.col("x").between(x0, x1) & F.col("y").between(y0, y1)
    return px.select("img", "x", "y", *(F.when(inside, F.col(c)).otherwise(0).alias(c) for c in RGBA))
