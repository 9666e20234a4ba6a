"""SVG values as Spark expressions: clocks, lengths, colours, transforms, gradients, animation progress.

Text that doesn't parse gives null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
#: Colour names and their rgba, fixed values.
NAMED_COLORS = """
aliceblue f0f8ffff; antiquewhite faebd7ff; aqua 00ffffff; aquamarine 7fffd4ff; azure f0ffffff; beige f5f5dcff
bisque ffe4c4ff; black 000000ff; blanchedalmond ffebcdff; blue 0000ffff; blueviolet 8a2be2ff; brown a52a2aff
burlywood deb887ff; cadetblue 5f9ea0ff; chartreuse 7fff00ff; chocolate d2691eff; coral ff7f50ff
cornflowerblue 6495edff; cornsilk fff8dcff; crimson dc143cff; cyan 00ffffff; darkblue 00008bff
darkcyan 008b8bff; darkgoldenrod b8860bff; darkgray a9a9a9ff; darkgreen 006400ff; darkgrey a9a9a9ff
darkkhaki bdb76bff; darkmagenta 8b008bff; darkolivegreen 556b2fff; darkorange ff8c00ff; darkorchid 9932ccff
darkred 8b0000ff; darksalmon e9967aff; darkseagreen 8fbc8fff; darkslateblue 483d8bff; darkslategray 2f4f4fff
darkslategrey 2f4f4fff; darkturquoise 00ced1ff; darkviolet 9400d3ff; deeppink ff1493ff; deepskyblue 00bfffff
dimgray 696969ff; dimgrey 696969ff; dodgerblue 1e90ffff; firebrick b22222ff; floralwhite fffaf0ff
forestgreen 228b22ff; fuchsia ff00ffff; gainsboro dcdcdcff; ghostwhite f8f8ffff; gold ffd700ff
goldenrod daa520ff; gray 808080ff; green 008000ff; greenyellow adff2fff; grey 808080ff; honeydew f0fff0ff
hotpink ff69b4ff; indianred cd5c5cff; indigo 4b0082ff; ivory fffff0ff; khaki f0e68cff; lavender e6e6faff
lavenderblush fff0f5ff; lawngreen 7cfc00ff; lemonchiffon fffacdff; lightblue add8e6ff; lightcoral f08080ff
lightcyan e0ffffff; lightgoldenrodyellow fafad2ff; lightgray d3d3d3ff; lightgreen 90ee90ff; lightgrey d3d3d3ff
lightpink ffb6c1ff; lightsalmon ffa07aff; lightseagreen 20b2aaff; lightskyblue 87cefaff
lightslategray 778899ff; lightslategrey 778899ff; lightsteelblue b0c4deff; lightyellow ffffe0ff; lime 00ff00ff
limegreen 32cd32ff; linen faf0e6ff; magenta ff00ffff; maroon 800000ff; mediumaquamarine 66cdaaff
mediumblue 0000cdff; mediumorchid ba55d3ff; mediumpurple 9370dbff; mediumseagreen 3cb371ff
mediumslateblue 7b68eeff; mediumspringgreen 00fa9aff; mediumturquoise 48d1ccff; mediumvioletred c71585ff
midnightblue 191970ff; mintcream f5fffaff; mistyrose ffe4e1ff; moccasin ffe4b5ff; navajowhite ffdeadff
navy 000080ff; oldlace fdf5e6ff; olive 808000ff; olivedrab 6b8e23ff; orange ffa500ff; orangered ff4500ff
orchid da70d6ff; palegoldenrod eee8aaff; palegreen 98fb98ff; paleturquoise afeeeeff; palevioletred db7093ff
papayawhip ffefd5ff; peachpuff ffdab9ff; peru cd853fff; pink ffc0cbff; plum dda0ddff; powderblue b0e0e6ff
purple 800080ff; rebeccapurple 663399ff; red ff0000ff; rosybrown bc8f8fff; royalblue 4169e1ff
saddlebrown 8b4513ff; salmon fa8072ff; sandybrown f4a460ff; seagreen 2e8b57ff; seashell fff5eeff
sienna a0522dff; silver c0c0c0ff; skyblue 87ceebff; slateblue 6a5acdff; slategray 708090ff; slategrey 708090ff
snow fffafaff; springgreen 00ff7fff; steelblue 4682b4ff; tan d2b48cff; teal 008080ff; thistle d8bfd8ff
tomato ff6347ff; turquoise 40e0d0ff; violet ee82eeff; wheat f5deb3ff; white ffffffff; whitesmoke f5f5f5ff
yellow ffff00ff; yellowgreen 9acd32ff
"""


def part(text: Column, pattern: str, group: int) -> Column:
    """A group of the match of the whole text, or null."""
    return F.when(text.rlike(f"(?s)^{pattern}$"), F.regexp_extract(text, f"(?s)^{pattern}$", group))


def clock_seconds(text: Column) -> Column:
    """A number with ms, s, m or h; a bare number is seconds."""
    pattern = rf"\s*{NUMBER}\s*([mM][sS]|s|m|h)?\s*"
    unit = F.lower(part(text, pattern, 2))
    scale = F.when(unit == "ms", 0.001).when(unit == "m", 60.0).when(unit == "h", 3600.0).otherwise(1.0)
    return part(text, pattern, 1).cast("double") * scale


def repeat_count(text: Column) -> Column:
    """Repetitions: infinity for "indefinite", 1 if there is no text, null where it isn't above 0."""
    value = part(text, rf"\s*{NUMBER}\s*", 1).cast("double")
    return (
        F.when(F.coalesce(text, F.lit("")) == "", 1.0)
        .when(F.lower(F.ltrim(text)) == "indefinite", F.lit(float("inf")))
        .when(value > 0, value)
    )


def smil_progress(t: Column, begin: Column, dur: Column, repeat: Column, freeze: Column) -> Column:
    """0..1 within a repetition, 1 when frozen after the end, null while it doesn't apply."""
    local = t - F.coalesce(begin, F.lit(0.0))
    times = F.coalesce(repeat, F.lit(1.0))
    phase = (local - F.floor(local / dur) * dur) / dur
    return F.when((dur <= 0) | dur.isNull() | (local < 0), None).when(local < dur * times, phase).when(freeze, 1.0)


def directed(direction: Column, cycle: Column, phase: Column) -> Column:
    """A phase by direction: reverse, and alternation by the cycle's parity."""
    odd = cycle % 2 == 1
    back = (direction == "reverse") | ((direction == "alternate") & odd) | ((direction == "alternate-reverse") & ~odd)
    return F.when(back, 1.0 - phase).otherwise(phase)


def css_progress(t: Column, delay: Column, duration: Column, repeats: Column, direction: Column, fill: Column) -> Column:
    """Progress of a CSS animation; ``repeats`` is infinity for infinite ones."""
    local = t - delay
    cycle = F.floor(local / duration)
    phase = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (local - cycle * duration) / duration))
    times = F.when(repeats > 0, repeats).otherwise(1.0)
    whole = F.floor(F.least(times, F.lit(1e9)))
    even = F.abs(times - whole) < 1e-6
    last = F.when(even, F.greatest(whole - 1, F.lit(0))).otherwise(whole)
    rest = F.when(even, 1.0).otherwise(times - whole)
    return (
        F.when((duration <= 0) | duration.isNull(), None)
        .when(local < 0, F.when(fill.isin("backwards", "both"), directed(direction, F.lit(0), F.lit(0.0))))
        .when(local < duration * times, directed(direction, cycle, phase))
        .when(fill.isin("forwards", "both"), directed(direction, last, rest))
    )


def length(text: Column, base: float = 0.0, dpi: float = 96.0) -> Column:
    """Pixels of a length: px pt pc in cm mm or a percentage of ``base``; other units count as px."""
    pattern = rf"\s*{NUMBER}\s*(%|px|pt|pc|in|cm|mm)?.*"
    value, unit = part(text, pattern, 1).cast("double"), part(text, pattern, 2)
    scale = F.lit(1.0)
    for name, factor in (("pt", dpi / 72), ("pc", dpi / 6), ("in", dpi), ("cm", dpi / 2.54), ("mm", dpi / 25.4)):
        scale = F.when(unit == name, factor).otherwise(scale)
    return F.when(unit == "%", F.when(F.lit(base > 0), value * base / 100.0)).otherwise(value * scale)


def named_colors() -> dict[str, str]:
    return dict(item.split() for item in NAMED_COLORS.replace("\n", ";").split(";") if item.strip())


def hue_channel(p: Column, q: Column, t: Column) -> Column:
    t = F.when(t < 0, t + 1.0).when(t > 1, t - 1.0).otherwise(t)
    return F.when(t < 1 / 6, p + (q - p) * 6.0 * t).when(t < 0.5, q).when(t < 2 / 3, p + (q - p) * (2 / 3 - t) * 6.0).otherwise(p)


def color(text: Column) -> Column:
    """A colour as eight hex digits; see ``color_of``. Run as a lambda, since its code would pass the size limit of a method."""
    return F.transform(F.array(F.lower(F.ltrim(text))), color_of)[0]


def color_of(s: Column) -> Column:
    """A lower-case colour as eight hex digits rgba, "none", or null: #rgb[a], #rrggbb[aa], rgb(), rgba(), hsl(), hsla(), names."""
    short = part(s, "#([0-9a-f]{3,4})", 1)
    doubled = F.concat(*(F.repeat(F.substring(short, k, 1), 2) for k in range(1, 5)))
    long = part(s, "#([0-9a-f]{6}|[0-9a-f]{8})", 1)
    value, gap = rf"{NUMBER}\s*(%?)", r"[\s,]*"
    tail = rf"(?:{gap}[/,]?\s*{NUMBER}\s*(%?))?\s*\)?.*"
    rgb = rf"rgba?\({gap}{value}{gap}{value}{gap}{value}{tail}"
    hsl = rf"hsla?\({gap}{NUMBER}\s*(deg|grad|rad|turn)?{gap}{value}{gap}{value}{tail}"

    def number(pattern: str, group: int) -> Column:
        got = part(s, pattern, group)
        return F.when(got != "", got).cast("double")

    def byte(v: Column) -> Column:
        return F.lower(F.lpad(F.hex(F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v))).cast("int")), 2, "0"))

    def alpha(pattern: str, group: int) -> Column:
        v, percent = number(pattern, group), part(s, pattern, group + 1) == "%"
        share = F.when(v.isNull(), 1.0).when(percent, v / 100.0).when(v <= 1, v).otherwise(v / 255.0)
        return byte(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * 255.0)

    # In single precision, as 50% has to be 127.5.
    channels = [number(rgb, k).cast("float") * F.when(part(s, rgb, k + 1) == "%", 2.55).otherwise(1.0).cast("float") for k in (1, 3, 5)]
    unit = part(s, hsl, 2)
    turn = F.when(unit == "grad", 0.9).when(unit == "rad", 180 / math.pi).when(unit == "turn", 360.0).otherwise(1.0)
    h = number(hsl, 1) * turn / 360.0
    h = h - F.floor(h)

    def fraction(k: int) -> Column:
        v = number(hsl, k)
        v = F.when((part(s, hsl, k + 1) == "%") | (v > 1), v / 100.0).otherwise(v)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))

    sat, light = fraction(3), fraction(5)
    q = F.when(light < 0.5, light * (1.0 + sat)).otherwise(light + sat - light * sat)
    p = 2.0 * light - q
    mixed = [F.when(sat <= 1e-6, light).otherwise(hue_channel(p, q, h + d)) * 255.0 for d in (1 / 3, 0.0, -1 / 3)]
    names = F.create_map(*(F.lit(x) for item in named_colors().items() for x in item))
    return (
        F.when(s == "none", "none")
        .when(short.isNotNull(), F.when(F.length(short) == 3, F.concat(F.substring(doubled, 1, 6), F.lit("ff"))).otherwise(doubled))
        .when(long.isNotNull(), F.rpad(long, 8, "f"))
        .when(s.rlike(f"^{rgb}$"), F.concat(*map(byte, channels), alpha(rgb, 7)))
        .when(s.rlike(f"^{hsl}$"), F.concat(*map(byte, mixed), alpha(hsl, 7)))
        .otherwise(F.try_element_at(names, s))
    )


def multiply(m: Column, n: Column) -> Column:
    """The affine map that applies ``n``, then ``m``; both struct<a,b,c,d,e,f>."""

    def of(x: str, y: str, z: str, w: str) -> Column:
        return m[x] * n[z] + m[y] * n[w]

    return F.struct(
        of("a", "c", "a", "b").alias("a"), of("b", "d", "a", "b").alias("b"), of("a", "c", "c", "d").alias("c"), of("b", "d", "c", "d").alias("d"),
        (of("a", "c", "e", "f") + m["e"]).alias("e"), (of("b", "d", "e", "f") + m["f"]).alias("f"),
    )


def moved(m: Column, x: Column, y: Column) -> tuple[Column, Column]:
    return m["a"] * x + m["c"] * y + m["e"], m["b"] * x + m["d"] * y + m["f"]


def spread(t: Column, method: str) -> Column:
    """Gradient parameters outside 0..1: pad, repeat or reflect."""
    if method == "repeat":
        return t - F.floor(t)
    if method == "reflect":
        u = t - 2.0 * F.floor(t / 2.0)
        return F.when(u > 1, 2.0 - u).otherwise(u)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))


def between(stops: Column, t: Column, value) -> Column:
    """Interpolate ``value(stop)`` of stops sorted by offset at ``t``; flat outside them.

    Stops travel with the row as one short array, so samples need no join by range.
    """
    n = F.size(F.filter(stops, lambda s: s["offset"] < t))
    low, high = F.get(stops, n - 1), F.get(stops, F.least(n, F.size(stops) - 1))
    gap = high["offset"] - low["offset"]
    u = F.when(gap > 0, F.least(F.lit(1.0), (t - low["offset"]) / gap)).otherwise(0.0)
    return F.when(n == 0, value(F.get(stops, F.lit(0))).cast("double")).otherwise(value(low) + (value(high) - value(low)) * u)
