"""Queries over single pixels: colour conversion, sample arithmetic, remaps, palettes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pixelloom.functions import color as C
from pixelloom.operators import compose, predictors, quantize, resample
from pixelloom.plans.registry import PIXEL, query
from pixelloom.sources.derived import doc_bytes, emb_px, line_px

SIZE = (4, 4)
PALETTE = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (128, 128, 0), (0, 128, 128), (128, 0, 128)]
_PAL_SQL = "pal(k, pr, pg, pb) AS (VALUES " + ", ".join(f"({k}, {r}, {g}, {b})" for k, (r, g, b) in enumerate(PALETTE)) + ")"


def channels():
    return [F.col(c) for c in "rgba"]


@query("alpha_over_white", "img x y r g b", "SELECT img, x, y, (r*a + 255*(255-a)) // 255 AS r, (g*a + 255*(255-a)) // 255 AS g, (b*a + 255*(255-a)) // 255 AS b FROM px")
def alpha_over_white(spark, sf):
    _, _, _, A = channels()
    return emb_px(spark, sf).select("img", "x", "y", *(C.over_white(F.col(c), A).alias(c) for c in "rgb"))


@query("alpha_over_background", "img x y r g b", "SELECT img, x, y, CASE WHEN a < 255 THEN (r*a + 32*(255-a)) // 255 ELSE r END AS r, CASE WHEN a < 255 THEN (g*a + 64*(255-a)) // 255 ELSE g END AS g, CASE WHEN a < 255 THEN (b*a + 96*(255-a)) // 255 ELSE b END AS b FROM px")
def alpha_over_background(spark, sf):
    _, _, _, A = channels()
    shown = {c: F.when(A < 255, C.over(F.col(c), A, F.lit(v))).otherwise(F.col(c)) for c, v in zip("rgb", (32, 64, 96))}
    return emb_px(spark, sf).withColumns(shown)


@query("premultiply_round_trip", PIXEL, "SELECT img, x, y, CASE WHEN a = 0 THEN 0 ELSE ((r*255 + a//2) // a) & 255 END AS r, CASE WHEN a = 0 THEN 0 ELSE ((g*255 + a//2) // a) & 255 END AS g, CASE WHEN a = 0 THEN 0 ELSE ((b*255 + a//2) // a) & 255 END AS b, a FROM pm")
def premultiply_round_trip(spark, sf):
    _, _, _, A = channels()
    from pixelloom.sources.derived import premultiplied

    return premultiplied(emb_px(spark, sf)).withColumns({c: C.unpremultiply(F.col(c), A) for c in "rgb"})


@query("premultiplied_detection", "img premultiplied:boolean", "SELECT img, bool_and(greatest(r, g, b) <= a) AND bool_or(a < 255) AS premultiplied FROM px GROUP BY img")
def premultiplied_detection(spark, sf):
    _, _, _, A = channels()
    return emb_px(spark, sf).groupBy("img").agg((F.bool_and(F.greatest("r", "g", "b") <= A) & F.bool_or(A < 255)).alias("premultiplied"))


@query("cmyk_to_rgb", "img x y r g b", "SELECT img, x, y, ((255-r)*(255-a) + 127) // 255 AS r, ((255-g)*(255-a) + 127) // 255 AS g, ((255-b)*(255-a) + 127) // 255 AS b FROM px")
def cmyk_to_rgb(spark, sf):
    _, _, _, A = channels()
    return emb_px(spark, sf).withColumns({c: C.cmyk_to_rgb(F.col(c), A) for c in "rgb"})


@query("jpeg_cmyk_to_rgb", "img x y r g b", "SELECT img, x, y, greatest(0, least(255, 255-(r+a))) AS r, greatest(0, least(255, 255-(g+a))) AS g, greatest(0, least(255, 255-(b+a))) AS b FROM px")
def jpeg_cmyk_to_rgb(spark, sf):
    _, _, _, A = channels()
    return emb_px(spark, sf).withColumns({c: C.inverted_cmyk_to_rgb(F.col(c), A) for c in "rgb"})


@query("jpeg_ycck_to_rgb", "img x y r g b", "yc AS (SELECT img, x, y, a AS k, greatest(0, least(255, r + ((91881*(b-128)) >> 16))) AS r, greatest(0, least(255, r - ((22554*(g-128) + 46802*(b-128)) >> 16))) AS g, greatest(0, least(255, r + ((116130*(g-128)) >> 16))) AS b FROM px)\n--\nSELECT img, x, y, greatest(0, r-k) AS r, greatest(0, g-k) AS g, greatest(0, b-k) AS b FROM yc")
def jpeg_ycck_to_rgb(spark, sf):
    R, G, B, A = channels()
    return emb_px(spark, sf).withColumns({n: F.greatest(F.lit(0), v - A) for n, v in zip("rgb", C.ycbcr_fixed(R, G, B))})


@query("ycbcr_float", "img x y r g b", "SELECT img, x, y, CAST(trunc(greatest(0.0, least(255.0, CAST(r AS DOUBLE) + CAST(1.402 AS DOUBLE)*(b-128)))) AS INTEGER) AS r, CAST(trunc(greatest(0.0, least(255.0, CAST(r AS DOUBLE) - CAST(0.344136 AS DOUBLE)*(g-128) - CAST(0.714136 AS DOUBLE)*(b-128)))) AS INTEGER) AS g, CAST(trunc(greatest(0.0, least(255.0, CAST(r AS DOUBLE) + CAST(1.772 AS DOUBLE)*(g-128)))) AS INTEGER) AS b FROM px")
def ycbcr_float(spark, sf):
    R, G, B, _ = channels()
    return emb_px(spark, sf).withColumns(dict(zip("rgb", C.ycbcr_float(R, G, B))))


@query("ycbcr_fixed", "img x y r g b", "SELECT img, x, y, greatest(0, least(255, r + ((91881*(b-128)) >> 16))) AS r, greatest(0, least(255, r - ((22554*(g-128) + 46802*(b-128)) >> 16))) AS g, greatest(0, least(255, r + ((116130*(g-128)) >> 16))) AS b FROM px")
def ycbcr_fixed(spark, sf):
    R, G, B, _ = channels()
    return emb_px(spark, sf).withColumns(dict(zip("rgb", C.ycbcr_fixed(R, G, B))))


_LAB = """lab AS (SELECT img, x, y, (CAST(r AS DOUBLE)*100/255 + 16)/116 AS fy, CAST(g AS DOUBLE)-128 AS la, CAST(b AS DOUBLE)-128 AS lb FROM px),
f AS (SELECT img, x, y, fy + la/500 AS fx, fy, fy - lb/200 AS fz FROM lab),
xyz AS (SELECT img, x, y, CASE WHEN fx*fx*fx > CAST(0.008856 AS DOUBLE) THEN fx*fx*fx ELSE (fx - CAST(16 AS DOUBLE)/116)/CAST(7.787 AS DOUBLE) END * CAST(0.95047 AS DOUBLE) AS vx,
  CASE WHEN fy*fy*fy > CAST(0.008856 AS DOUBLE) THEN fy*fy*fy ELSE (fy - CAST(16 AS DOUBLE)/116)/CAST(7.787 AS DOUBLE) END AS vy,
  CASE WHEN fz*fz*fz > CAST(0.008856 AS DOUBLE) THEN fz*fz*fz ELSE (fz - CAST(16 AS DOUBLE)/116)/CAST(7.787 AS DOUBLE) END * CAST(1.08883 AS DOUBLE) AS vz FROM f)
--
SELECT img, x, y, trunc(greatest(0.0, least(255.0, (vx*CAST(3.2406 AS DOUBLE) + vy*CAST(-1.5372 AS DOUBLE) + vz*CAST(-0.4986 AS DOUBLE))*255 + 0.5))) AS r,
 trunc(greatest(0.0, least(255.0, (vx*CAST(-0.9689 AS DOUBLE) + vy*CAST(1.8758 AS DOUBLE) + vz*CAST(0.0415 AS DOUBLE))*255 + 0.5))) AS g,
 trunc(greatest(0.0, least(255.0, (vx*CAST(0.0557 AS DOUBLE) + vy*CAST(-0.2040 AS DOUBLE) + vz*CAST(1.0570 AS DOUBLE))*255 + 0.5))) AS b FROM xyz"""


@query("cielab_to_rgb", "img x y r g b", _LAB)
def cielab_to_rgb(spark, sf):
    R, G, B, _ = channels()
    return emb_px(spark, sf).withColumns(dict(zip("rgb", C.cielab(R, G - 128, B - 128))))


@query("gray_white_is_zero", "img x y g", "SELECT img, x, y, 255 - g AS g FROM px")
def gray_white_is_zero(spark, sf):
    _, G, _, _ = channels()
    return emb_px(spark, sf).withColumn("g", C.gray_inverted(G))


@query("palette16_lookup", "img x y r g b", "SELECT img, x, y, (((r % 64) * 1021) % 65536 + 128) // 257 AS r, (((r % 64) * 2039) % 65536 + 128) // 257 AS g, (((r % 64) * 4093) % 65536 + 128) // 257 AS b FROM px")
def palette16_lookup(spark, sf):
    """A 64-entry colour map of 16-bit values, joined by index."""
    R, _, _, _ = channels()
    n = F.col("id")
    table = spark.range(64).select(n.cast("int").alias("idx"), *(C.sample16_to_8(n * m % 65536).alias("p" + c) for c, m in zip("rgb", (1021, 2039, 4093))))
    px = emb_px(spark, sf).withColumn("idx", R % 64)
    return px.join(F.broadcast(table), "idx").select("img", "x", "y", *(F.col("p" + c).alias(c) for c in "rgb"))


@query("sample_scaling", "img x y s1 s2 s4 s16 w16 f8", "SELECT img, x, y, ((r & 1)*255) // 1 AS s1, ((r & 3)*255 + 1) // 3 AS s2, ((r & 15)*255 + 7) // 15 AS s4, (r*256 + g + 128) // 257 AS s16, ((r*256 + g)*255 + 32767) // 65535 AS w16, CASE WHEN b / 200.0 <= 1 THEN trunc(b / CAST(200 AS DOUBLE) * 255 + 0.5) ELSE trunc(b / CAST(200 AS DOUBLE) + 0.5) END AS f8 FROM px")
def sample_scaling(spark, sf):
    """Samples of 1, 2, 4, 16 bits and floats to 8 bits."""
    R, G, B, _ = channels()
    wide, real = R * 256 + G, B / F.lit(200.0)
    f8 = F.floor(F.when(real <= 1.0, real * 255.0 + 0.5).otherwise(real + 0.5))
    return emb_px(spark, sf).select(
        "img", "x", "y",
        *(C.scale_bits(R.bitwiseAND((1 << n) - 1), n).alias(f"s{n}") for n in (1, 2, 4)),
        C.sample16_to_8(wide).alias("s16"), C.scale_bits(wide, 16).alias("w16"), f8.alias("f8"),
    )


@query("rgb555_565", "img x y r5 g5 b5 r6 g6 b6", "w AS (SELECT img, x, y, r*256 + g AS v FROM px)\n--\nSELECT img, x, y, (((v>>10)&31)*255+15)//31 AS r5, (((v>>5)&31)*255+15)//31 AS g5, ((v&31)*255+15)//31 AS b5, (((v>>11)&31)*255+15)//31 AS r6, (((v>>5)&63)*255+31)//63 AS g6, ((v&31)*255+15)//31 AS b6 FROM w")
def rgb555_565(spark, sf):
    R, G, _, _ = channels()
    v = R * 256 + G
    names = ("r5", "g5", "b5", "r6", "g6", "b6")
    return emb_px(spark, sf).select("img", "x", "y", *(c.alias(n) for n, c in zip(names, [*C.rgb555(v), *C.rgb565(v)])))


@query("bitfield_extract", "img x y lo5 mid6 hi5 wide", "w AS (SELECT img, x, y, r*256 + g AS v, CAST(r AS BIGINT)*16777216 + g*65536 + b*256 + a AS q FROM px)\n--\nSELECT img, x, y, ((v&31)*255+15)//31 AS lo5, (((v>>5)&63)*255+31)//63 AS mid6, (((v>>11)&31)*255+15)//31 AS hi5, ((q & 67107840) >> 10) >> 8 AS wide FROM w")
def bitfield_extract(spark, sf):
    R, G, B, A = channels()
    v = R * 256 + G
    q = R.cast("long") * 16777216 + G * 65536 + B * 256 + A
    return emb_px(spark, sf).select(
        "img", "x", "y", C.mask_extract(v, 0x001F).alias("lo5"), C.mask_extract(v, 0x07E0).alias("mid6"), C.mask_extract(v, 0xF800).alias("hi5"),
        C.mask_extract(q, 67107840).alias("wide"),
    )


@query("paeth_predictor", "img x y p", "d AS (SELECT img, x, y, r, g, b, abs(g-b) AS pa, abs(r-b) AS pb, abs(r+g-2*b) AS pc FROM px)\n--\nSELECT img, x, y, CASE WHEN pa <= pb AND pa <= pc THEN r WHEN pb <= pc THEN g ELSE b END AS p FROM d")
def paeth_predictor(spark, sf):
    R, G, B, _ = channels()
    return emb_px(spark, sf).withColumn("p", C.paeth(R, G, B))


@query("scanline_geometry", "img x y rb1 rb4 s1 s2 s4", "SELECT img, x, y, (r + 7) // 8 AS rb1, (r*12 + 7) // 8 AS rb4, (g >> (7 - x)) & 1 AS s1, (g >> ((3 - x % 4)*2)) & 3 AS s2, (g >> ((1 - x % 2)*4)) & 15 AS s4 FROM px")
def scanline_geometry(spark, sf):
    R, G, _, _ = channels()
    return emb_px(spark, sf).select(
        "img", "x", "y", C.row_bytes(R, 1, 1).alias("rb1"), C.row_bytes(R, 3, 4).alias("rb4"),
        *(C.packed_sample(G, F.col("x"), n).alias(f"s{n}") for n in (1, 2, 4)),
    )


@query("gamma_correction", "img x y r g b", "SELECT img, x, y, floor(pow(r/CAST(255 AS DOUBLE), 1/CAST(2.2 AS DOUBLE))*255 + 0.5) AS r, floor(pow(g/CAST(255 AS DOUBLE), 1/CAST(2.2 AS DOUBLE))*255 + 0.5) AS g, floor(pow(b/CAST(255 AS DOUBLE), 1/CAST(2.2 AS DOUBLE))*255 + 0.5) AS b FROM px")
def gamma_correction(spark, sf):
    """A table of 256 gamma values, joined by channel value."""
    lut = spark.range(256).select(F.col("id").cast("int").alias("v"), C.gamma_byte(F.col("id"), 2.2).alias("o"))
    px = emb_px(spark, sf)
    for c in "rgb":
        px = px.join(F.broadcast(lut.select(F.col("v").alias(c), F.col("o").alias("o" + c))), c)
    return px.select("img", "x", "y", *(F.col("o" + c).alias(c) for c in "rgb"))


@query("color_correction", PIXEL, "SELECT img, x, y, ((255-r)*257 + 128) // 257 AS r, ((g*g) % 65536 + 128) // 257 AS g, (b*128 + 128) // 257 AS b, a FROM px")
def color_correction(spark, sf):
    """Per-channel tables of 256 values of 16 bits."""
    v = F.col("id")
    lut = spark.range(256).select(v.cast("int").alias("v"), C.sample16_to_8((255 - v) * 257).alias("r2"), C.sample16_to_8(v * v % 65536).alias("g2"), C.sample16_to_8(v * 128).alias("b2"))
    px = emb_px(spark, sf)
    for c in "rgb":
        px = px.join(F.broadcast(lut.select(F.col("v").alias(c), F.col(c + "2"))), c)
    return px.select("img", "x", "y", *(F.col(c + "2").alias(c) for c in "rgb"), "a")


@query("subtract_green", PIXEL, "SELECT img, x, y, (r+g) & 255 AS r, g, (b+g) & 255 AS b, a FROM px")
def subtract_green(spark, sf):
    _, G, _, _ = channels()
    return emb_px(spark, sf).withColumns({c: (F.col(c) + G).bitwiseAND(255) for c in "rb"})


@query("cross_color", "img x y r b", "s AS (SELECT img, x, y, r, CASE WHEN g > 127 THEN g-256 ELSE g END AS gs, b FROM px), t AS (SELECT img, x, y, gs, (r + ((25*gs) >> 5)) & 255 AS r, b FROM s)\n--\nSELECT img, x, y, r, (b + ((-11*gs) >> 5) + ((7*CASE WHEN r > 127 THEN r-256 ELSE r END) >> 5)) & 255 AS b FROM t")
def cross_color(spark, sf):
    """Signed multiplies of the lossless colour transform, here with one tile's factors."""
    R, G, B, _ = channels()

    def signed(c):
        return F.when(c > 127, c - 256).otherwise(c)

    gs = signed(G)
    red = emb_px(spark, sf).withColumn("r", (R + F.shiftright(25 * gs, 5)).bitwiseAND(255))
    return red.withColumn("b", (B + F.shiftright(-11 * gs, 5) + F.shiftright(7 * signed(R), 5)).bitwiseAND(255))


@query("color_indexing", "img x y idx r g b", _PAL_SQL + ", i AS (SELECT img, x, y, (g >> ((x % 2)*4)) & 15 AS idx FROM px)\n--\nSELECT img, x, y, idx, coalesce(pr, 0) AS r, coalesce(pg, 0) AS g, coalesce(pb, 0) AS b FROM i LEFT JOIN pal ON k = idx")
def color_indexing(spark, sf):
    """Two packed indices a byte; an index beyond the table gives 0."""
    _, G, _, _ = channels()
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(PALETTE)], "idx int, r int, g int, b int")
    px = emb_px(spark, sf).select("img", "x", "y", F.call_function("shiftright", G, (F.col("x") % 2 * 4).cast("int")).bitwiseAND(15).alias("idx"))
    return px.join(F.broadcast(table), "idx", "left").fillna(0, ["r", "g", "b"])


@query("orientation", "img x y o r", " UNION ALL ".join(f"SELECT img, {nx} AS x, {ny} AS y, {o} AS o, r FROM px" for o, nx, ny in ((1, "x", "y"), (2, "3-x", "y"), (3, "3-x", "3-y"), (4, "x", "3-y"), (5, "y", "x"), (6, "3-y", "x"), (7, "3-y", "3-x"), (8, "y", "3-x"))))
def orientation(spark, sf):
    px = emb_px(spark, sf)
    parts = [resample.orient(px, o, SIZE).select("img", "x", "y", F.lit(o).alias("o"), "r") for o in range(1, 9)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("deinterlace", "h row place", "g AS (SELECT h, unnest(range(h)) AS row FROM (SELECT unnest(range(1, 65)) AS h)), n AS (SELECT *, (h+7)//8 AS n1, (h+3)//8 AS n2, (h+1)//4 AS n3 FROM g)\n--\nSELECT h, row, CASE WHEN row < n1 THEN row*8 WHEN row < n1+n2 THEN (row-n1)*8+4 WHEN row < n1+n2+n3 THEN (row-n1-n2)*4+2 ELSE (row-n1-n2-n3)*2+1 END AS place FROM n")
def deinterlace(spark, sf):
    grid = spark.range(1, 65).select(F.col("id").alias("h"), F.explode(F.sequence(F.lit(0), F.col("id") - 1)).alias("row"))
    return grid.withColumn("place", resample.deinterlaced_row(F.col("row"), F.col("h")))


@query("palette_blit", PIXEL, _PAL_SQL + ", i AS (SELECT img, x, y, r % 10 AS idx FROM px)\n--\nSELECT px.img, px.x, px.y, coalesce(pr, r) AS r, coalesce(pg, g) AS g, coalesce(pb, b) AS b, CASE WHEN pr IS NULL THEN a ELSE 255 END AS a FROM px JOIN i USING (img, x, y) LEFT JOIN pal ON k = idx AND idx <> 3")
def palette_blit(spark, sf):
    R, _, _, _ = channels()
    px = emb_px(spark, sf)
    table = spark.createDataFrame([(k, *p) for k, p in enumerate(PALETTE)], "idx int, pr int, pg int, pb int")
    return compose.palette_blit(px, px.select("img", "x", "y", (R % 10).alias("idx")), table, 3)


@query("gif_keep_disposal", "grp frame x y v", "f AS (SELECT img // 8 AS grp, img % 8 AS frame, x, y, CASE WHEN a >= 128 THEN r END AS v FROM px)\n--\nSELECT grp, frame, x, y, (SELECT arg_max(v, o.frame) FROM f o WHERE o.grp = f.grp AND o.x = f.x AND o.y = f.y AND o.frame <= f.frame AND o.v IS NOT NULL) AS v FROM f")
def gif_keep_disposal(spark, sf):
    """Groups of eight images as frames of one animation that is never erased."""
    R, _, _, A = channels()
    frames = emb_px(spark, sf).select(C.div(F.col("img"), 8).alias("grp"), (F.col("img") % 8).alias("frame"), "x", "y", F.when(A >= 128, R).alias("v"))
    return predictors.last_drawn(frames, ["grp", "x", "y"], "frame", "v")


@query("nearest_palette", "img x y idx", _PAL_SQL + ", d AS (SELECT img, x, y, k, (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb) AS d FROM px, pal)\n--\nSELECT img, x, y, arg_min(k, d*1000 + k) AS idx FROM d GROUP BY img, x, y")
def nearest_palette(spark, sf):
    return quantize.nearest_palette(emb_px(spark, sf), PALETTE)


_BAYER = "[" + ", ".join(map(str, quantize.BAYER)) + "]"


@query("ordered_dither", "img x y idx", _PAL_SQL + f", m AS (SELECT img, x, y, greatest(0, least(255, r + t)) AS r, greatest(0, least(255, g + t)) AS g, greatest(0, least(255, b + t)) AS b FROM (SELECT *, {_BAYER}[(y % 4)*4 + x % 4 + 1]*16 - 128 AS t FROM px)), d AS (SELECT img, x, y, k, (r-pr)*(r-pr) + (g-pg)*(g-pg) + (b-pb)*(b-pb) AS d FROM m, pal)\n--\nSELECT img, x, y, arg_min(k, d*1000 + k) AS idx FROM d GROUP BY img, x, y")
def ordered_dither(spark, sf):
    return quantize.ordered_dither(emb_px(spark, sf), PALETTE)


_FIT = """o AS (SELECT unnest(range(3)) AS ox), c AS (SELECT a.ox AS x, b.ox AS y FROM o a, o b),
s AS (SELECT x, y, CAST(floor(x*4/CAST(3 AS DOUBLE) + (sx+0.5)*((x+1)*4/CAST(3 AS DOUBLE) - x*4/CAST(3 AS DOUBLE))/4) AS INTEGER) AS px_, CAST(floor(y*4/CAST(3 AS DOUBLE) + (sy+0.5)*((y+1)*4/CAST(3 AS DOUBLE) - y*4/CAST(3 AS DOUBLE))/4) AS INTEGER) AS py_ FROM c, (SELECT unnest(range(4)) AS sx), (SELECT unnest(range(4)) AS sy)),
w AS (SELECT img, x, y, (r*a + 255*(255-a)) // 255 AS r, (g*a + 255*(255-a)) // 255 AS g, (b*a + 255*(255-a)) // 255 AS b FROM px),
fit AS (SELECT img, s.x, s.y, CAST(sum(r) AS BIGINT) // 16 AS r, CAST(sum(g) AS BIGINT) // 16 AS g, CAST(sum(b) AS BIGINT) // 16 AS b FROM s JOIN w ON w.x = least(3, px_) AND w.y = least(3, py_) GROUP BY img, s.x, s.y)"""


@query("fit_scale", "img x y r g b", _FIT + "\n--\nSELECT * FROM fit")
def fit_scale(spark, sf):
    """4x4 images into at most 3x3 cells."""
    return resample.fit(emb_px(spark, sf), 3, 3, SIZE)


@query("ansi_rows", "img y line:string", _FIT + ", l AS (SELECT *, lag([r,g,b]) OVER (PARTITION BY img, y ORDER BY x) AS p FROM fit)\n--\nSELECT img, y, string_agg(CASE WHEN p IS NOT NULL AND p = [r,g,b] THEN '' ELSE chr(27) || '[48;2;' || r || ';' || g || ';' || b || 'm' END || ' ', '' ORDER BY x) || chr(27) || '[0m' || chr(10) AS line FROM l GROUP BY img, y")
def ansi_rows(spark, sf):
    from pixelloom.sinks.ansi import ansi_rows as rows

    return rows(resample.fit(emb_px(spark, sf), 3, 3, SIZE))


@query("supersample_resolve", PIXEL, "m AS (SELECT img, x//2 AS x, y//2 AS y, CAST(sum(r) AS BIGINT)//4 AS r, CAST(sum(g) AS BIGINT)//4 AS g, CAST(sum(b) AS BIGINT)//4 AS b, CAST(sum(a) AS BIGINT)//4 AS a FROM pm GROUP BY img, x//2, y//2)\n--\nSELECT img, x, y, CASE WHEN a > 0 THEN (r*255//a) & 255 ELSE 0 END AS r, CASE WHEN a > 0 THEN (g*255//a) & 255 ELSE 0 END AS g, CASE WHEN a > 0 THEN (b*255//a) & 255 ELSE 0 END AS b, a FROM m")
def supersample_resolve(spark, sf):
    from pixelloom.sources.derived import premultiplied

    return resample.resolve(premultiplied(emb_px(spark, sf)), 2)


@query("predictor_sub", "img x y r g", "SELECT img, x, y, ((sum(r) OVER w) % 256 + 256) % 256 AS r, ((sum(g) OVER v) % 256 + 256) % 256 AS g FROM px WINDOW w AS (PARTITION BY img, y ORDER BY x), v AS (PARTITION BY img, x ORDER BY y)")
def predictor_sub(spark, sf):
    """Rows of differences summed along x; columns along y."""
    px = emb_px(spark, sf).select("img", "x", "y", "r", "g")
    return predictors.undo_sub(predictors.undo_sub(px, ["img", "y"], "x", "r"), ["img", "x"], "y", "g")


@query("predictor_16bit", "img seq v", "l AS (SELECT l_suppkey AS img, l_orderkey*8 + l_linenumber AS seq, (CAST(l_quantity AS BIGINT)*5 % 256)*256 + CAST(floor(l_extendedprice) AS BIGINT) % 256 AS v FROM lineitem), u AS (SELECT img, seq, CAST(sum(v) AS BIGINT) AS v FROM l GROUP BY img, seq)\n--\nSELECT img, seq, (sum(v) OVER (PARTITION BY img ORDER BY seq)) % 65536 AS v FROM u")
def predictor_16bit(spark, sf):
    """One long row per supplier: windows at scale."""
    R, _, _, A = channels()
    px = line_px(spark, sf).groupBy("img", "seq").agg(F.sum(R * 256 + A).alias("v"))
    return predictors.undo_sub(px, ["img"], "seq", "v", 65536)


_BYTES = "db AS (SELECT doc_id, i, ascii(unhex(substr(h, 2*i + 1, 2))) AS b0, ('0x' || substr(h, 2*i + 1, 2))::INTEGER AS b FROM (SELECT doc_id, h, unnest(range(length(h)//2)) AS i FROM (SELECT doc_id, hex(encode(text)) AS h FROM documents)))".replace("ascii(unhex(substr(h, 2*i + 1, 2))) AS b0, ", "")


@query("adler32", "doc_id n adler32", _BYTES + "\n--\nSELECT doc_id, count(*) AS n, ((count(*) + CAST(sum((n - i)*b) AS HUGEINT)) % 65521)*65536 + (1 + CAST(sum(b) AS BIGINT)) % 65521 AS adler32 FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM db) GROUP BY doc_id")
def adler32(spark, sf):
    return predictors.adler32(doc_bytes(spark, sf), "doc_id", "i", "b")


@query("static_zlib_size", "doc_id n zlib_size", _BYTES + "\n--\nSELECT doc_id, count(*) AS n, 6 + (3 + CAST(sum(CASE WHEN b < 144 THEN 8 ELSE 9 END) AS BIGINT) + 14) // 8 AS zlib_size FROM db GROUP BY doc_id")
def static_zlib_size(spark, sf):
    return predictors.static_zlib_size(doc_bytes(spark, sf), "doc_id", "b")


@query("base64_text", "doc_id n b64:string", "SELECT doc_id, length(b64) AS n, b64 FROM (SELECT doc_id, base64(encode(text)) AS b64 FROM documents)")
def base64_text(spark, sf):
    from pixelloom.sinks.kitty import base64_text as b64
    from pixelloom.sources.derived import table

    return table(spark, sf, "documents").select("doc_id", b64(F.encode("text", "UTF-8")).alias("b64")).withColumn("n", F.length("b64"))
