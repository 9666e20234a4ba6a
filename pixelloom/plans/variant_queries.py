"""Round trips of the formats' other variants, on images of many blocks, tiles and strips."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from pixelloom.plans.codec_queries import pages, pdf_rects, pixels, round_trip, written
from pixelloom.plans.registry import PIXEL, query
from pixelloom.sources import documents, images
from pixelloom.sources.codecs import write
from pixelloom.sources.derived import emb_px

GRAYS = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 3, 1)
SIXTEEN = GRAYS[::17]
#: Every image five times across and down.
WIDE = "FROM px, (SELECT unnest(range(5)) AS i) s, (SELECT unnest(range(5)) AS j) t"
_AT = "img, x + 4 * i AS x, y + 4 * j AS y"


def wide(px: np.ndarray) -> np.ndarray:
    return np.tile(px, (5, 5, 1))


round_trip("bmp_rle8_decode", lambda px: write.bmp_runs(wide(px)[..., 0], GRAYS, 8), f"SELECT {_AT}, r, r AS g, r AS b, 255 AS a {WIDE}")
round_trip("bmp_rle4_decode", lambda px: write.bmp_runs(wide(px)[..., 0] >> 4, SIXTEEN, 4), f"SELECT {_AT}, (r >> 4) * 17 AS r, (r >> 4) * 17 AS g, (r >> 4) * 17 AS b, 255 AS a {WIDE}")
round_trip("tga_color_map_decode", lambda px: write.tga_mapped(wide(px)[..., 1], GRAYS), f"SELECT {_AT}, g AS r, g, g AS b, 255 AS a {WIDE}")
round_trip("tga_flip_mirror_decode", lambda px: write.tga_mapped(wide(px)[..., 1], GRAYS, 0x10), f"SELECT {_AT}, g AS r, g, g AS b, 255 AS a {WIDE}")
for _tile in (0, 16):
    for _planar in (False, True):
        round_trip(
            f"tiff_{'tiles' if _tile else 'strips'}_{'planar' if _planar else 'chunky'}_decode",
            lambda px, tile=_tile, planar=_planar: write.tiff_parts(wide(px)[..., :3], tile=tile, planar=planar),
            f"SELECT {_AT}, r, g, b, 255 AS a {WIDE}",
        )
round_trip("webp_lossless_decode", lambda px: write.webp_lossless(wide(px)), f"SELECT {_AT}, r, g, b, a {WIDE}")
round_trip("webp_subtract_green_decode", lambda px: write.webp_lossless(wide(px), less_green=True), f"SELECT {_AT}, r, g, b, a {WIDE}")

_BLOCKS = "SELECT img, 8 * x + i AS x, 8 * y + j AS y, r, r AS g, r AS b, 255 AS a FROM px, (SELECT unnest(range(8)) AS i) s, (SELECT unnest(range(8)) AS j) t"
round_trip("jpeg_standard_tables_decode", lambda px: write.jpeg_flat(px[..., 0]), _BLOCKS)
round_trip("jpeg_restart_decode", lambda px: write.jpeg_flat(px[..., 0], restart=3), _BLOCKS)
round_trip("jpeg_progressive_decode", lambda px: write.jpeg_flat(px[..., 0], progressive=True), _BLOCKS)


def svg_of(px: np.ndarray, cell, before: str = "", after: str = "", style: str = "") -> bytes:
    """A document of one element a pixel."""
    h, w = px.shape[:2]
    cells = "".join(cell(x, y, "#" + "".join(f"{v:02x}" for v in px[y, x, :3])) for y in range(h) for x in range(w))
    return f'<svg width="{w}" height="{h}">{style}{before}{cells}{after}</svg>'.encode()


OPAQUE = "SELECT img, x, y, r, g, b, 255 AS a FROM px"
round_trip("svg_path_render", lambda px: svg_of(px, lambda x, y, c: f'<path fill="{c}" d="M{x} {y}h1v1H{x}z"/>'), OPAQUE)
round_trip("svg_polygon_render", lambda px: svg_of(px, lambda x, y, c: f'<polygon fill="{c}" points="{x},{y} {x + 1},{y} {x + 1},{y + 1} {x},{y + 1}"/>'), OPAQUE)
round_trip("svg_transform_render", lambda px: svg_of(px, lambda x, y, c: f'<rect fill="{c}" width="0.5" height="1" transform="translate({x} {y}) scale(2 1)"/>'), OPAQUE)
round_trip("svg_matrix_render", lambda px: svg_of(px, lambda x, y, c: f'<rect fill="{c}" width="1" height="1" transform="matrix(0 1 1 0 {x} {y})"/>'), OPAQUE)
round_trip("svg_use_render", lambda px: svg_of(px, lambda x, y, c: f'<use href="#u" fill="{c}" x="{x}" y="{y}"/>', '<defs><rect id="u" width="1" height="1"/></defs>'), OPAQUE)
round_trip("svg_stroke_render", lambda px: svg_of(px, lambda x, y, c: f'<line stroke="{c}" stroke-width="1" x1="{x}" y1="{y + 0.5}" x2="{x + 1}" y2="{y + 0.5}"/>'), OPAQUE)
round_trip("svg_class_cascade_render", lambda px: svg_of(px, lambda x, y, c: f'<rect class="c" fill="red" style="fill:{c}" width="1" height="1" x="{x}" y="{y}"/>', style="<style>.c{fill:blue}</style>"), OPAQUE)


def pdf_flate(px: np.ndarray) -> bytes:
    """The page of rectangles with its content compressed."""
    plain = pdf_rects(px)
    head, _, rest = plain.partition(b"stream\n")
    draw, _, tail = rest.partition(b"\nendstream")
    packed = zlib.compress(draw)
    head = head.replace(f"/Length {len(draw)}".encode(), f"/Filter /FlateDecode /Length {len(packed)}".encode())
    return head + b"stream\n" + packed + b"\nendstream" + tail


@query("pdf_flate_render", PIXEL, OPAQUE)
def pdf_flate_render(spark, sf):
    """Every image as rectangles on a page whose content is compressed."""
    return pixels(images.decode_images(written(spark, sf, pdf_flate), trim=False))


@query("svg_document_size", "img width height", "SELECT vec_id AS img, 4 AS width, 4 AS height FROM embeddings")
def svg_document_size(spark, sf):
    """Dimensions alone, by expressions."""
    files = written(spark, sf, lambda px: svg_of(px, lambda x, y, c: ""))
    return documents.svg_dimensions(files).withColumn("img", F.col("path").cast("long"))


@query("static_zlib_stream", "img n same:boolean", "SELECT vec_id AS img, 64 AS n, true AS same FROM embeddings")
def static_zlib_stream(spark, sf):
    """Pixels as zlib streams in the fixed code, inflated again."""

    @F.pandas_udf(BooleanType())
    def same(rgba: pd.Series) -> pd.Series:
        return pd.Series([zlib.decompress(write.zlib_static(bytes(r))) == bytes(r) for r in rgba])

    return pages(spark, sf).select("img", F.octet_length("rgba").alias("n"), same("rgba").alias("same"))


_NAMES = {"svg": ("svg",), "png": ("png",), "jpeg": ("jpg", "jpeg"), "gif": ("gif",), "bmp": ("bmp",), "tiff": ("tif", "tiff"), "tga": ("tga",), "webp": ("webp",), "pdf": ("pdf",), "ico": ("ico",), "cur": ("cur",)}
_LIST = [(kind, name) for kind, names in _NAMES.items() for name in names] + [(None, "txt")]


@query(
    "extension_tests", "img name:string format:string",
    "SELECT vec_id AS img, 'dir.x/f' || vec_id || '.' || CASE WHEN vec_id % 2 = 0 THEN n ELSE upper(n) END AS name, k AS format FROM embeddings, (VALUES "
    + ", ".join(f"({'NULL' if k is None else repr(k)}, '{n}')" for k, n in _LIST) + ") t(k, n)",
)
def extension_tests(spark, sf):
    """Formats by file names, whatever their case."""
    img = emb_px(spark, sf).select("img").distinct()
    ends = F.explode(F.array(*(F.lit(n) for _, n in _LIST)))
    named = img.select("img", ends.alias("n")).withColumn("n", F.when(F.col("img") % 2 == 0, F.col("n")).otherwise(F.upper("n")))
    named = named.withColumn("name", F.concat(F.lit("dir.x/f"), F.col("img").cast("string"), F.lit("."), F.col("n")))
    return named.withColumn("format", images.format_of_name(F.col("name")))


@query("bmp_compression_names", "img name:string", "SELECT vec_id AS img, ['RGB', 'RLE8', 'RLE4', 'BITFIELDS', 'JPEG', 'PNG', 'ALPHABITFIELDS', 'UNKNOWN'][vec_id % 8 + 1] AS name FROM embeddings")
def bmp_compression_names(spark, sf):
    """Names of the compression numbers that BMP headers hold."""
    img = emb_px(spark, sf).select("img").distinct()
    return img.withColumn("name", images.bmp_compression_name(F.col("img") % 8))
