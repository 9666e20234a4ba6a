"""Colour and sample arithmetic as Spark expressions, in integers where the result is one.

Every function takes and returns Columns, stays inside whole-stage code generation,
and truncates towards zero where C would.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b) -> Column:
    """Integer division, towards zero."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b)).cast("int")


def clamp(v: Column, low: float = 0, high: float = 255) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), v))


def over(c: Column, a: Column, background) -> Column:
    """A straight colour over an opaque background."""
    return div(c * a + background * (255 - a), 255)


def over_white(c: Column, a: Column) -> Column:
    return over(c, a, F.lit(255))


def cmyk_to_rgb(c: Column, k: Column) -> Column:
    """One of red, green, blue from its complement and black, rounded."""
    return div((255 - c) * (255 - k) + 127, 255)


def inverted_cmyk_to_rgb(c: Column, k: Column) -> Column:
    return clamp(255 - (c + k)).cast("int")


def ycbcr_float(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """Floating-point conversion, clamped, then truncated."""
    u, v = cb - 128.0, cr - 128.0
    r = y + 1.402 * v
    g = y - 0.344136 * u - 0.714136 * v
    b = y + 1.772 * u
    return tuple(clamp(x, 0.0, 255.0).cast("int") for x in (r, g, b))


def ycbcr_fixed(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    """16-bit fixed point with arithmetic shifts; also the full-range conversion of lossy WebP."""
    u, v = cb - 128, cr - 128
    r = y + F.shiftright(91881 * v, 16)
    g = y - F.shiftright(22554 * u + 46802 * v, 16)
    b = y + F.shiftright(116130 * u, 16)
    return tuple(clamp(x).cast("int") for x in (r, g, b))


def gray_inverted(g: Column) -> Column:
    return 255 - g


def unpremultiply(c: Column, a: Column) -> Column:
    """Rounded division by alpha, wrapped to a byte; transparent pixels lose their colour."""
    return F.when(a == 0, F.lit(0)).otherwise(div(c * 255 + div(a, 2), a).bitwiseAND(255))


def scale_bits(v: Column, bits: int) -> Column:
    """An unsigned sample of ``bits`` bits to 8, rounded."""
    most = (1 << bits) - 1
    return div(v * 255 + most // 2, most)


def sample16_to_8(v: Column) -> Column:
    return div(v + 128, 257)


def paeth(a: Column, b: Column, c: Column) -> Column:
    """The neighbour (left, above, upper left) nearest to a + b - c; ties go in that order."""
    p = a + b - c
    pa, pb, pc = F.abs(p - a), F.abs(p - b), F.abs(p - c)
    return F.when((pa <= pb) & (pa <= pc), a).when(pb <= pc, b).otherwise(c)


def mask_shift(mask: int) -> tuple[int, int]:
    """(shift, width) of a bit-field mask."""
    if not mask:
        return 0, 0
    shift = (mask & -mask).bit_length() - 1
    return shift, bin(mask >> shift).count("1")


def mask_extract(value: Column, mask: int) -> Column:
    """A bit field scaled to 8 bits: wide fields lose low bits, narrow ones are stretched."""
    shift, width = mask_shift(mask)
    if not width:
        return F.lit(0)
    v = F.shiftright(value.bitwiseAND(mask), shift)
    if width >= 8:
        return F.shiftright(v, width - 8).cast("int")
    return scale_bits(v, width)


def rgb555(v: Column) -> list[Column]:
    return [scale_bits(F.shiftright(v, s).bitwiseAND(31), 5) for s in (10, 5, 0)]


def rgb565(v: Column) -> list[Column]:
    return [
        scale_bits(F.shiftright(v, 11).bitwiseAND(31), 5),
        scale_bits(F.shiftright(v, 5).bitwiseAND(63), 6),
        scale_bits(v.bitwiseAND(31), 5),
    ]


def gamma_byte(v: Column, gamma: float) -> Column:
    return F.floor(F.pow(v / 255.0, F.lit(1.0 / gamma)) * 255.0 + 0.5).cast("int")


def row_bytes(width: Column, channels: int, depth: int) -> Column:
    """Bytes of a scanline of packed samples."""
    return div(width * (channels * depth) + 7, 8)


def packed_sample(byte: Column, x: Column, depth: int) -> Column:
    """Sample x of a row, packed big-endian with ``depth`` bits, from its byte."""
    per = 8 // depth
    return F.call_function("shiftright", byte, ((per - 1 - x % per) * depth).cast("int")).bitwiseAND((1 << depth) - 1)


def cielab(l: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b* as bytes (a and b signed) to linear RGB, D65, clamped and truncated."""
    big = l * 100.0 / 255.0
    fy = (big + 16.0) / 116.0
    fx, fz = fy + a / 500.0, fy - b / 200.0

    def solid(t: Column) -> Column:
        cube = t * t * t
        return F.when(cube > 0.008856, cube).otherwise((t - 16.0 / 116.0) / 7.787)

    x, y, z = solid(fx) * 0.95047, solid(fy), solid(fz) * 1.08883
    mixed = (
        x * 3.2406 + y * -1.5372 + z * -0.4986,
        x * -0.9689 + y * 1.8758 + z * 0.0415,
        x * 0.0557 + y * -0.2040 + z * 1.0570,
    )
    return tuple(clamp(v * 255.0 + 0.5, 0.0, 255.0).cast("int") for v in mixed)


def uint32(v: Column) -> Column:
    return v.bitwiseAND(4294967295)


def little_endian(content: Column, at: int, size: int) -> Column:
    """An unsigned little-endian integer of a binary column, at a zero-based place."""
    return F.conv(F.hex(F.reverse(F.substring(content, at + 1, size).cast("string"))), 16, 10).cast("long")
