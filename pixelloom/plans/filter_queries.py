"""Queries over neighbourhoods and pairs of images: filter primitives, blending, lighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.operators import compose, filters
from pixelloom.plans.registry import PIXEL, query
from pixelloom.sources.derived import emb_px, premultiplied

SIZE = (4, 4)
D = "CAST({} AS DOUBLE)".format


def pm(spark, sf):
    return premultiplied(emb_px(spark, sf))


def partner(spark, sf):
    """The next image, under this one's number."""
    return pm(spark, sf).withColumn("img", F.col("img") - 1)


def each(template: str, channels: str = "rgba") -> str:
    return ", ".join(template.replace("§", c) + f" AS {c}" for c in channels)


_KERNEL = ", ".join(f"({k - 3}, {v!r})" for k, v in enumerate(filters.gaussian_kernel(0.8)))
_BLUR = f"""k(d, v) AS (SELECT d, {D('v')} FROM (VALUES {_KERNEL}) t(d, v)),
bx AS (SELECT p.img, p.x, p.y, {each("CAST(round(greatest(0, least(255, round(sum(s.§ * v), 6)))) AS INTEGER)")} FROM pm p, k JOIN pm s ON s.img = p.img AND s.y = p.y AND s.x = greatest(0, least(3, p.x + d)) GROUP BY p.img, p.x, p.y)
--
SELECT p.img, p.x, p.y, {each("round(greatest(0, least(255, round(sum(s.§ * v), 6))))")} FROM bx p, k JOIN bx s ON s.img = p.img AND s.x = p.x AND s.y = greatest(0, least(3, p.y + d)) GROUP BY p.img, p.x, p.y"""


@query("gaussian_blur", PIXEL, _BLUR)
def gaussian_blur(spark, sf):
    return filters.gaussian_blur(pm(spark, sf), 0.8, 0.8, SIZE)


@query("filter_offset", PIXEL, f"SELECT p.img, p.x, p.y, {each('coalesce(s.§, 0)')} FROM pm p LEFT JOIN pm s ON s.img = p.img AND s.x = p.x - 1 AND s.y = p.y + 2")
def filter_offset(spark, sf):
    return filters.offset(pm(spark, sf), 1, -2)


_STRAIGHT = "st AS (SELECT img, x, y, a / CAST(255 AS DOUBLE) AS fa, CASE WHEN a > 0 THEN r / CAST(255 AS DOUBLE) / (a / CAST(255 AS DOUBLE)) ELSE 0 END AS fr, CASE WHEN a > 0 THEN g / CAST(255 AS DOUBLE) / (a / CAST(255 AS DOUBLE)) ELSE 0 END AS fg, CASE WHEN a > 0 THEN b / CAST(255 AS DOUBLE) / (a / CAST(255 AS DOUBLE)) ELSE 0 END AS fb FROM pm)"


def _matrix_sql(name: str, m: list[float]) -> str:
    rows = []
    for k, c in zip(range(0, 20, 5), "rgba"):
        terms = " + ".join(f"f{v} * {D(repr(float(x)))}" for v, x in zip("rgba", m[k : k + 4]))
        rows.append(f"greatest(0.0, least(1.0, {D(repr(float(m[k + 4])))} + {terms})) AS n{c}")
    return f"SELECT '{name}' AS kind, img, x, y, {', '.join(rows)} FROM st"


_MATRICES = {"saturate": filters.saturate(0.4), "hueRotate": filters.hue_rotate(60), "luminanceToAlpha": filters.LUMINANCE_TO_ALPHA}
_CM = f"""{_STRAIGHT}, m AS ({' UNION ALL '.join(_matrix_sql(n, m) for n, m in _MATRICES.items())})
--
SELECT kind, img, x, y, {', '.join(f'round(round(n{c} * na * 255, 6)) AS {c}' for c in 'rgb')}, round(round(na * 255, 6)) AS a FROM m"""


def _kinds(parts):
    out = None
    for name, df in parts.items():
        named = df.withColumn("kind", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


@query("color_matrix", "kind:string " + PIXEL, _CM)
def color_matrix(spark, sf):
    return _kinds({n: filters.color_matrix(pm(spark, sf), m) for n, m in _MATRICES.items()})


_CT = f"""{_STRAIGHT}, t AS (SELECT img, x, y,
 (CASE WHEN least(1, fr) >= 1 THEN 0.8 ELSE [0.1, 0.9, 0.3, 0.8][CAST(floor(least(1, fr)*3) AS INTEGER) + 1] + ([0.1, 0.9, 0.3, 0.8][CAST(floor(least(1, fr)*3) AS INTEGER) + 2] - [0.1, 0.9, 0.3, 0.8][CAST(floor(least(1, fr)*3) AS INTEGER) + 1]) * (least(1, fr)*3 - floor(least(1, fr)*3)) END) AS nr,
 [0.0, 0.5, 1.0][CAST(least(floor(least(1, fg)*3), 2) AS INTEGER) + 1] AS ng,
 greatest(0.0, least(1.0, least(1, fb)*0.5 + 0.25)) AS nb, pow(fa, 2) AS na FROM st)
--
SELECT img, x, y, {', '.join(f'round(round(CAST(n{c} AS DOUBLE) * na * 255, 6)) AS {c}' for c in 'rgb')}, round(round(na * 255, 6)) AS a FROM t"""


@query("component_transfer", PIXEL, _CT)
def component_transfer(spark, sf):
    return filters.component_transfer(
        pm(spark, sf),
        r=("table", {"table": (0.1, 0.9, 0.3, 0.8)}),
        g=("discrete", {"table": (0.0, 0.5, 1.0)}),
        b=("linear", {"slope": 0.5, "intercept": 0.25}),
        a=("gamma", {"exponent": 2.0}),
    )


_CONV = "kk(dx, dy, v) AS (VALUES (-1,-1,1),(0,-1,2),(1,-1,-1),(-1,0,0),(0,0,4),(1,0,1),(-1,1,-2),(0,1,1),(1,1,0))"


@query("convolve_matrix", "edge:string " + PIXEL, f"""{_CONV}, e AS (
SELECT 'duplicate' AS edge, p.img, p.x, p.y, {each('sum(s.§ * v)')} FROM pm p, kk JOIN pm s ON s.img = p.img AND s.x = greatest(0, least(3, p.x+dx)) AND s.y = greatest(0, least(3, p.y+dy)) GROUP BY p.img, p.x, p.y
UNION ALL SELECT 'wrap', p.img, p.x, p.y, {each('sum(s.§ * v)')} FROM pm p, kk JOIN pm s ON s.img = p.img AND s.x = (p.x+dx+4) % 4 AND s.y = (p.y+dy+4) % 4 GROUP BY p.img, p.x, p.y
UNION ALL SELECT 'none', p.img, p.x, p.y, {each('sum(s.§ * v)')} FROM pm p, kk JOIN pm s ON s.img = p.img AND s.x = p.x+dx AND s.y = p.y+dy GROUP BY p.img, p.x, p.y)
--
SELECT edge, img, x, y, {each('round(greatest(0, least(255, round(CAST(§ AS DOUBLE) / 6 + CAST(0.1 AS DOUBLE)*255, 6))))')} FROM e""")
def convolve_matrix(spark, sf):
    kernel = [[1, 2, -1], [0, 4, 1], [-2, 1, 0]]
    parts = {e: filters.convolve(pm(spark, sf), kernel, divisor=6, bias=0.1, edge=e, size=SIZE) for e in ("duplicate", "wrap", "none")}
    out = None
    for name, df in parts.items():
        named = df.withColumn("edge", F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


_HASH = "(((({h}) ^ (({h}) >> 13)) * 1274126177) & 4294967295)"


def _noise(x: str, y: str, seed: int) -> str:
    first = f"xor(({x}::BIGINT * 374761393 + {y}::BIGINT * 668265263) & 4294967295, {seed})"
    second = f"((xor({first}, ({first}) >> 13)) * 1274126177) & 4294967295"
    return f"((xor(({second}), ({second}) >> 16)) & 65535) / CAST(65535 AS DOUBLE)"


def _value_noise(fx: float, fy: float, seed: int) -> str:
    ux, uy = f"(x * {D(fx)})", f"(y * {D(fy)})"
    x0, y0 = f"floor({ux})", f"floor({uy})"
    tx, ty = f"({ux} - {x0})", f"({uy} - {y0})"
    u, v = f"({tx}*{tx}*(3 - 2*{tx}))", f"({ty}*{ty}*(3 - 2*{ty}))"
    n = {(i, j): _noise(f"({x0} + {i})", f"({y0} + {j})", seed) for i in (0, 1) for j in (0, 1)}
    top = f"({n[0, 0]} + ({n[1, 0]} - {n[0, 0]}) * {u})"
    low = f"({n[0, 1]} + ({n[1, 1]} - {n[0, 1]}) * {u})"
    return f"(({top} + ({low} - {top}) * {v}) * 2 - 1)"


@query("turbulence", PIXEL, f"v AS (SELECT img, x, y, round(round(greatest(0, least(1, (abs({_value_noise(0.3, 0.7, 5)}) + abs({_value_noise(0.6, 1.4, 22)}) * 0.5) / 1.5)) * 255, 6)) AS c FROM px)\n--\nSELECT img, x, y, c AS r, c AS g, c AS b, 255 AS a FROM v")
def turbulence(spark, sf):
    return filters.turbulence(emb_px(spark, sf), 0.3, 0.7, 2, 5)


@query("displacement_map", PIXEL, "s AS (SELECT img, x, y, CASE WHEN a > 0 THEN r / CAST(255 AS DOUBLE) / (a / CAST(255 AS DOUBLE)) ELSE 0 END AS cr, a / CAST(255 AS DOUBLE) AS ca FROM pn), m AS (SELECT img, x, y, CAST(greatest(0, least(3, round(x + (cr - 0.5)*3))) AS INTEGER) AS sx, CAST(greatest(0, least(3, round(y + (ca - 0.5)*3))) AS INTEGER) AS sy FROM s)\n--\nSELECT m.img, m.x, m.y, r, g, b, a FROM m JOIN pm ON pm.img = m.img AND pm.x = sx AND pm.y = sy")
def displacement_map(spark, sf):
    return filters.displacement(pm(spark, sf), partner(spark, sf), 3.0, "r", "a", SIZE)


_SOBEL = """al AS (SELECT img, x, y, a / CAST(255 AS DOUBLE) AS v FROM pm),
n AS (SELECT c.img, c.x, c.y, max(CASE WHEN c.x = s.x AND c.y = s.y THEN s.v END) AS v,
 sum(dx * (2 - abs(dy)) * s.v) AS gx, sum(dy * (2 - abs(dx)) * s.v) AS gy
 FROM al c, (VALUES (-1),(0),(1)) a(dx), (VALUES (-1),(0),(1)) b(dy) JOIN al s ON s.img = c.img AND s.x = greatest(0, least(3, c.x + dx)) AND s.y = greatest(0, least(3, c.y + dy)) GROUP BY c.img, c.x, c.y),
d AS (SELECT n.img, n.x, n.y, pm.a / CAST(255 AS DOUBLE) AS al, sqrt(4*gx*gx + 4*gy*gy + 1) AS nl, gx*-2 AS nx, gy*-2 AS ny FROM n JOIN pm USING (img, x, y)),
t AS (SELECT img, x, y, al, nl, (nx + 2*ny + 2) / (nl * 3) AS dot FROM d)"""


@query("diffuse_lighting", PIXEL, _SOBEL + "\n--\nSELECT img, x, y, " + ", ".join(f"round(greatest(0, least(255, round({c} / CAST(255 AS DOUBLE) * greatest(0, least(1, CASE WHEN dot > 0 THEN dot * CAST(1.5 AS DOUBLE) ELSE 0 END)) * al * 255, 6)))) AS {n}" for n, c in zip("rgb", (255, 200, 64))) + ", round(al * 255) AS a FROM t")
def diffuse_lighting(spark, sf):
    return filters.lighting(pm(spark, sf), (1, 2, 2), (255, 200, 64), surface_scale=2.0, constant=1.5)


@query("specular_lighting", PIXEL, _SOBEL + ", s AS (SELECT *, al * greatest(0, least(1, CASE WHEN dot > 0 AND 2*dot/nl - CAST(2 AS DOUBLE)/3 > 0 THEN pow(2*dot/nl - CAST(2 AS DOUBLE)/3, 3) * CAST(0.9 AS DOUBLE) ELSE 0 END)) AS oa FROM t)\n--\nSELECT img, x, y, " + ", ".join(f"round(greatest(0, least(255, round({c} / CAST(255 AS DOUBLE) * oa * 255, 6)))) AS {n}" for n, c in zip("rgb", (255, 200, 64))) + ", round(round(oa * 255, 6)) AS a FROM s")
def specular_lighting(spark, sf):
    return filters.lighting(pm(spark, sf), (1, 2, 2), (255, 200, 64), surface_scale=2.0, constant=0.9, exponent=3.0)


@query("flood_clipped", PIXEL, "SELECT img, x, y, CASE WHEN x BETWEEN 1 AND 2 AND y BETWEEN 0 AND 2 THEN 200*128//255 ELSE 0 END AS r, CASE WHEN x BETWEEN 1 AND 2 AND y BETWEEN 0 AND 2 THEN 100*128//255 ELSE 0 END AS g, CASE WHEN x BETWEEN 1 AND 2 AND y BETWEEN 0 AND 2 THEN 50*128//255 ELSE 0 END AS b, CASE WHEN x BETWEEN 1 AND 2 AND y BETWEEN 0 AND 2 THEN 128 ELSE 0 END AS a FROM px")
def flood_clipped(spark, sf):
    return filters.region_clip(filters.flood(emb_px(spark, sf), (200, 100, 50, 128)), 1, 0, 2, 2)


@query("tile_region", PIXEL, f"SELECT img, x, y, {each('CASE WHEN x >= 1 AND y <= 2 THEN § ELSE 0 END')} FROM pm")
def tile_region(spark, sf):
    return filters.tile(pm(spark, sf), 1, 0, 3, 2)


@query("morphology", "kind:string " + PIXEL, " UNION ALL ".join(f"SELECT '{n}' AS kind, p.img, p.x, p.y, {each(f + '(s.§)')} FROM pm p JOIN pm s ON s.img = p.img AND abs(s.x - p.x) <= 1 AND abs(s.y - p.y) <= 2 GROUP BY p.img, p.x, p.y" for n, f in (("dilate", "max"), ("erode", "min"))))
def morphology(spark, sf):
    return _kinds({"dilate": filters.morphology(pm(spark, sf), 1, 2, True), "erode": filters.morphology(pm(spark, sf), 1, 2, False)})


_BOTH = "j AS (SELECT p.img, p.x, p.y, " + ", ".join(f"p.{c} / CAST(255 AS DOUBLE) AS p{c}, n.{c} / CAST(255 AS DOUBLE) AS q{c}" for c in "rgba") + " FROM pm p JOIN pn n USING (img, x, y)), k AS (SELECT *, " + ", ".join(f"CASE WHEN pa > 0 THEN p{c}/pa ELSE 0 END AS s{c}, CASE WHEN qa > 0 THEN q{c}/qa ELSE 0 END AS t{c}" for c in "rgb") + ", pa + qa - pa*qa AS oa FROM j)"
_MIX = {
    "normal": "t§",
    "multiply": "s§*t§",
    "screen": "1 - (1-s§)*(1-t§)",
    "darken": "least(s§, t§)",
    "lighten": "greatest(s§, t§)",
    "overlay": "CASE WHEN s§ <= 0.5 THEN 2*s§*t§ ELSE 1 - 2*(1-s§)*(1-t§) END",
    "hard-light": "CASE WHEN t§ <= 0.5 THEN 2*s§*t§ ELSE 1 - 2*(1-s§)*(1-t§) END",
    "soft-light": "CASE WHEN t§ <= 0.5 THEN s§ - (1-2*t§)*s§*(1-s§) ELSE s§ + (2*t§-1)*((CASE WHEN s§ <= 0.25 THEN ((16*s§-12)*s§+4)*s§ ELSE sqrt(s§) END) - s§) END",
}


def _blend_sql(mode: str) -> str:
    out = []
    for c in "rgb":
        m = _MIX[mode].replace("§", c)
        p = f"(p{c}*(1-qa) + q{c}*(1-pa) + ({m})*pa*qa)"
        out.append(f"round(round(greatest(0, least(1, CASE WHEN oa > 1e-6 THEN {p}/oa ELSE 0 END)) * greatest(0, least(1, oa)) * 255, 6)) AS {c}")
    return f"SELECT '{mode}' AS kind, img, x, y, {', '.join(out)}, round(round(greatest(0, least(1, oa)) * 255, 6)) AS a FROM k"


@query("blend_modes", "kind:string " + PIXEL, _BOTH + "\n--\n" + " UNION ALL ".join(map(_blend_sql, _MIX)))
def blend_modes(spark, sf):
    return _kinds({m: compose.blend(pm(spark, sf), partner(spark, sf), m) for m in _MIX})


_PORTER = {
    "over": "p§ + q§*(1-pa)",
    "in": "p§*qa",
    "out": "p§*(1-qa)",
    "atop": "p§*qa + q§*(1-pa)",
    "xor": "p§*(1-qa) + q§*(1-pa)",
    "arithmetic": "p§*q§*CAST(0.5 AS DOUBLE) + p§*CAST(0.25 AS DOUBLE) + q§*CAST(0.5 AS DOUBLE) + CAST(-0.1 AS DOUBLE)",
}


@query("composite_operators", "kind:string " + PIXEL, _BOTH + "\n--\n" + " UNION ALL ".join(f"SELECT '{m}' AS kind, img, x, y, {each('round(round(greatest(0, least(1, ' + f + ')) * 255, 6))')} FROM k" for m, f in _PORTER.items()))
def composite_operators(spark, sf):
    return _kinds({m: compose.composite(pm(spark, sf), partner(spark, sf), m, (0.5, 0.25, 0.5, -0.1)) for m in _PORTER})


@query("source_over", PIXEL, f"SELECT p.img, p.x, p.y, {each('(n.§ + p.§*(255-n.a)//255) & 255')} FROM pm p JOIN pn n USING (img, x, y)")
def source_over(spark, sf):
    return compose.source_over(pm(spark, sf), partner(spark, sf))


@query("merge_layers", PIXEL, f"o AS (SELECT p.img, p.x, p.y, {each('(n.§ + p.§*(255-n.a)//255) & 255')} FROM pm p JOIN pn n USING (img, x, y)), f AS (SELECT img, x, y, 60*100//255 AS r, 120*100//255 AS g, 180*100//255 AS b, 100 AS a FROM px)\n--\nSELECT o.img, o.x, o.y, {each('(f.§ + o.§*(255-f.a)//255) & 255')} FROM o JOIN f USING (img, x, y)")
def merge_layers(spark, sf):
    return compose.merge([pm(spark, sf), partner(spark, sf), filters.flood(emb_px(spark, sf), (60, 120, 180, 100))])


@query("luminance_mask", PIXEL, f"m AS (SELECT p.*, ((54*n.r + 183*n.g + 19*n.b + 128) >> 8) * n.a // 255 AS l FROM pm p JOIN pn n USING (img, x, y))\n--\nSELECT img, x, y, {each('§*l//255')} FROM m")
def luminance_mask(spark, sf):
    return compose.masked(pm(spark, sf), partner(spark, sf))
