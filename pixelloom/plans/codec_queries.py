"""Round trips: images written by our own writers, decoded from bytes, and compared as pixels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from pixelloom.plans.registry import PIXEL, query
from pixelloom.sources import images
from pixelloom.sources.codecs import write
from pixelloom.sources.derived import emb_px


def pages(spark, sf) -> DataFrame:
    """(img, width, height, rgba) of every embedding."""
    return images.assemble_pixels(emb_px(spark, sf))


def written(spark, sf, make) -> DataFrame:
    """(path, content): each image by a writer, named by its number."""

    @F.pandas_udf(BinaryType())
    def file(rgba: pd.Series, width: pd.Series, height: pd.Series) -> pd.Series:
        return pd.Series([make(np.frombuffer(r, np.uint8).reshape(h, w, 4)) for r, w, h in zip(rgba, width, height)])

    return pages(spark, sf).select(F.col("img").cast("string").alias("path"), file("rgba", "width", "height").alias("content"))


def pixels(decoded: DataFrame) -> DataFrame:
    return images.explode_pixels(decoded.where("error is null")).withColumn("img", F.col("path").cast("long"))


ALL = "SELECT * FROM px"
OPAQUE = "SELECT img, x, y, r, g, b, 255 AS a FROM px"


def round_trip(name: str, make, sql: str = ALL) -> None:
    @query(name, PIXEL, sql)
    def run(spark, sf):
        return pixels(images.decode_images(written(spark, sf, make)))

    run.__doc__ = f"Every image through the {name.split('_')[0]} writer and decoder."


_KEEP = "SELECT p.* FROM px p JOIN (SELECT img, bool_and(greatest(r, g, b) <= a) AND bool_or(a < 255) AS pre FROM px GROUP BY img) USING (img) WHERE NOT pre"


round_trip("bmp24_decode", lambda px: write.bmp24(px[..., :3]), OPAQUE)
round_trip("tga_decode", write.tga32)
round_trip("tga_rle_decode", lambda px: write.tga32(px, True))
round_trip("png_decode", write.png)
round_trip("png_adam7_decode", lambda px: write.png(px, interlace=True))
round_trip("ico_decode", lambda px: write.ico([px[:1], px])[:0] or write.ico([px]))
round_trip("tiff_decode", lambda px: write.tiff([px], rows=3))
round_trip("tiff_lzw_predictor_decode", lambda px: write.tiff([px], compression=5, predictor=2))
round_trip("tiff_deflate_big_endian_decode", lambda px: write.tiff([px], order=">", compression=8))
round_trip("tiff_packbits_decode", lambda px: write.tiff([px], compression=32773, rows=2))


@query("bmp32_bitfields_decode", PIXEL, _KEEP)
def bmp32_bitfields_decode(spark, sf):
    """Images that the premultiplied test would not touch come back as they were."""
    px = emb_px(spark, sf)
    touched = px.groupBy("img").agg((F.bool_and(F.greatest("r", "g", "b") <= F.col("a")) & F.bool_or(F.col("a") < 255)).alias("pre"))
    decoded = pixels(images.decode_images(written(spark, sf, write.bmp32)))
    return decoded.join(touched.where("not pre").select("img"), "img", "left_semi")


@query("tiff_pages", "img page x y r", "SELECT img, p AS page, CASE WHEN p = 0 THEN x ELSE 3 - x END AS x, y, r FROM px, (VALUES (0), (1)) t(p)")
def tiff_pages(spark, sf):
    """Two pages a file, the second mirrored; all are decoded."""
    decoded = images.decode_images(written(spark, sf, lambda px: write.tiff([px, px[:, ::-1]])), page="all")
    named = decoded.where("error is null").withColumn("key", F.concat_ws("/", "path", "page"))
    px = images.explode_pixels(named, "key")
    part = F.split("key", "/")
    return px.withColumns({"img": part[0].cast("long"), "page": part[1].cast("int")})


@query("tiff_tag_table", "img ifd tag kind n first", "SELECT vec_id AS img, 0 AS ifd, tag, kind, n, first FROM embeddings, (VALUES (256, 4, 1, 4), (257, 4, 1, 4), (259, 3, 1, 1), (262, 3, 1, 2), (277, 3, 1, 4), (278, 4, 1, 4), (279, 4, 1, 64), (274, 3, 1, 1), (317, 3, 1, 1), (338, 3, 1, 2), (258, 3, 4, 8)) t(tag, kind, n, first)")
def tiff_tag_table(spark, sf):
    tags = images.tiff_tags(written(spark, sf, lambda px: write.tiff([px])))
    return tags.where("tag <> 273").select(
        F.col("path").cast("long").alias("img"), "ifd", "tag", F.col("type").alias("kind"), F.col("count").alias("n"), F.element_at("values", 1).alias("first")
    )


@query("icon_directory", "img entry width height planes bitcount size place is_cursor:boolean", "SELECT vec_id AS img, e AS entry, 4 AS width, 4 - 2*e AS height, 7 AS planes, 9 AS bitcount, CASE WHEN e = 0 THEN 120 ELSE 80 END AS size, CASE WHEN e = 0 THEN 38 ELSE 158 END AS place, true AS is_cursor FROM embeddings, (VALUES (0), (1)) t(e)")
def icon_directory(spark, sf):
    """Entries of a cursor file with two pages, by expressions."""
    d = images.icon_directory(written(spark, sf, lambda px: write.ico([px, px[:2]], True, (7, 9))))
    return d.withColumns({"img": F.col("path").cast("long"), "place": F.col("offset")})


@query("cursor_hotspot", "img hotspot_x hotspot_y", "SELECT vec_id AS img, 7 AS hotspot_x, 9 AS hotspot_y FROM embeddings")
def cursor_hotspot(spark, sf):
    d = images.decode_images(written(spark, sf, lambda px: write.ico([px], True, (7, 9))))
    return d.withColumn("img", F.col("path").cast("long"))


GRAYS = np.repeat(np.arange(16, dtype=np.uint8)[:, None] * 17, 3, 1)


def gray_gif(px: np.ndarray, **options) -> bytes:
    frames = [px[..., k] >> 4 for k in range(3)]
    return write.gif(frames, GRAYS, delays=[30, 0, 70], transparent=0, loops=3, **options)


_GIF = "f AS (SELECT img, x, y, 0 AS frame_no, r >> 4 AS v FROM px UNION ALL SELECT img, x, y, 1, g >> 4 FROM px UNION ALL SELECT img, x, y, 2, b >> 4 FROM px)"


@query("gif_animation", "img frame_no delay_ms loop_count x y r a", _GIF + ", k AS (SELECT img, x, y, frame_no, last_value(nullif(v, 0) IGNORE NULLS) OVER (PARTITION BY img, x, y ORDER BY frame_no) AS v FROM f)\n--\nSELECT img, frame_no, [30, 0, 70][frame_no + 1] AS delay_ms, 3 AS loop_count, x, y, coalesce(v * 17, 0) AS r, 255 AS a FROM k")
def gif_animation(spark, sf):
    """Three frames of sixteen greys, index 0 transparent, nothing disposed of."""
    frames = images.decode_frames(written(spark, sf, gray_gif))
    named = frames.withColumn("key", F.concat_ws("/", "path", "frame_no", "delay_ms", "loop_count"))
    px = images.explode_pixels(named, "key")
    part = F.split("key", "/")
    return px.withColumns({n: part[k].cast("long") for k, n in enumerate(("img", "frame_no", "delay_ms", "loop_count"))})


@query("gif_first_frame", "img x y r", "SELECT img, x, y, (r >> 4) * 17 AS r FROM px")
def gif_first_frame(spark, sf):
    """Interlaced; the background is the first grey, black."""
    return pixels(images.decode_images(written(spark, sf, lambda px: gray_gif(px, interlace=True))))


@query("frame_start_times", "img frame_no start_ms", "SELECT vec_id AS img, k AS frame_no, [0, 30, 30][k + 1] AS start_ms FROM embeddings, (VALUES (0), (1), (2)) t(k)")
def frame_start_times(spark, sf):
    from pixelloom.operators.predictors import start_times

    frames = images.decode_frames(written(spark, sf, gray_gif))
    return start_times(frames, "path", "frame_no", "delay_ms").withColumn("img", F.col("path").cast("long"))


_FORMATS = {"png": write.png, "bmp": write.bmp32, "tga": write.tga32, "ico": lambda p: write.ico([p]), "cur": lambda p: write.ico([p], True), "tiff": lambda p: write.tiff([p]), "gif": gray_gif}


@query("format_dispatch", "img written:string format:string", "SELECT vec_id AS img, f AS written, f AS format FROM embeddings, (VALUES " + ", ".join(f"('{f}')" for f in _FORMATS) + ") t(f)")
def format_dispatch(spark, sf):
    """Files of all kinds, told apart by their bytes."""
    out = None
    for name, make in _FORMATS.items():
        part = images.with_format(written(spark, sf, make)).select(F.col("path").alias("img"), F.lit(name).alias("written"), "format")
        out = part if out is None else out.unionByName(part)
    return out


@query("error_rows", "img error:string", "SELECT vec_id AS img, CASE vec_id % 4 WHEN 0 THEN 'invalid PNG signature' WHEN 1 THEN 'unknown image format' WHEN 2 THEN 'empty file' ELSE 'truncated pixel data' END AS error FROM embeddings")
def error_rows(spark, sf):
    """Broken files become rows with an error."""
    whole = written(spark, sf, lambda px: write.bmp24(px[..., :3]))
    kind = F.col("path").cast("long") % 4
    broken = F.when(kind == 0, F.unhex(F.lit("424D"))).when(kind == 1, F.encode(F.lit("plain"), "UTF-8")).when(kind == 2, F.unhex(F.lit(""))).otherwise(F.substring("content", 1, 80))
    fixed = F.when(kind == 3, F.concat(F.substring("content", 1, 2), F.unhex(F.lit("00000000")), F.substring("content", 7, 74))).otherwise(broken)
    df = images.with_format(whole.withColumn("content", fixed)).withColumn("format", F.when(kind == 0, "png").otherwise(F.col("format")))
    return images.decode_images(df).withColumn("img", F.col("path").cast("long"))


def svg_rects(px: np.ndarray) -> bytes:
    """A rectangle for every pixel, its colour by a rule for even rows and by an attribute for odd ones."""
    cells = [(x, y, "".join(f"{v:02x}" for v in px[y, x, :3])) for y in range(px.shape[0]) for x in range(px.shape[1])]
    css = "".join(f"#c{x}_{y}{{fill:#{c}}}" for x, y, c in cells if y % 2 == 0)
    rects = "".join(f'<rect id="c{x}_{y}" x="{x}" y="{y}" width="1" height="1"' + (f' fill="#{c}"' if y % 2 else "") + "/>" for x, y, c in cells)
    return f'<svg width="{px.shape[1]}" height="{px.shape[0]}"><style>{css}</style><g>{rects}</g></svg>'.encode()


round_trip("svg_render", svg_rects, OPAQUE)


def pdf_rects(px: np.ndarray) -> bytes:
    """A page of 3/4 point a pixel, filled rectangle by rectangle."""
    h, w = px.shape[:2]
    draw = "\n".join(
        f"{r / 255:.6f} {g / 255:.6f} {b / 255:.6f} rg {0.75 * x} {0.75 * (h - 1 - y)} 0.75 0.75 re f"
        for y in range(h) for x in range(w) for r, g, b in [px[y, x, :3].tolist()]
    )
    page = f"3 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 {0.75 * w} {0.75 * h}] /Contents 4 0 R >>\nendobj\n"
    tree = "1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\n2 0 obj\n<< /Type /Pages /Kids [3 0 R] /Count 1 >>\nendobj\n"
    return f"%PDF-1.4\n{tree}{page}4 0 obj\n<< /Length {len(draw)} >>\nstream\n{draw}\nendstream\nendobj\ntrailer\n<< /Root 1 0 R >>\nstartxref\n9\n%%EOF\n".encode()


@query("pdf_render", PIXEL, OPAQUE)
def pdf_render(spark, sf):
    """Every image as rectangles on a page, rendered untrimmed."""
    return pixels(images.decode_images(written(spark, sf, pdf_rects), trim=False))


@query("pdf_operator_counts", "img op:string n", "SELECT vec_id AS img, op, 16 AS n FROM embeddings, (VALUES ('rg'), ('re'), ('f')) t(op)")
def pdf_operator_counts(spark, sf):
    ops = images.pdf_operators(written(spark, sf, pdf_rects))
    return ops.groupBy(F.col("path").cast("long").alias("img"), "op").agg(F.count(F.lit(1)).alias("n"))


@query("svg_sample_times", "img step x r", "SELECT img, s AS step, x + 2*s AS x, r FROM px, (VALUES (0), (1), (2)) t(s) WHERE y = 0")
def svg_sample_times(spark, sf):
    """Four moving pixels, sampled at three times: rendering by (document, time) rows."""
    def moving(px: np.ndarray) -> bytes:
        move = '<animate attributeName="x" from="{0}" to="{1}" dur="2s" fill="freeze"/>'
        rects = "".join(f'<rect y="0" x="{x}" width="1" height="1" fill="#{px[0, x, 0]:02x}0000">{move.format(x, x + 4)}</rect>' for x in range(4))
        return f'<svg width="8" height="1">{rects}</svg>'.encode()

    files, out = written(spark, sf, moving), None
    for step in range(3):
        px = pixels(images.decode_images(files, time=float(step))).where("a = 255").withColumn("step", F.lit(step))
        out = px if out is None else out.unionByName(px)
    return out
