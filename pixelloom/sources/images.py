"""Image files as tables: format dispatch, decoding, pages, frames, pixels.

``files`` is Spark's own binary-file source, so path and length filters prune before
a byte is read. The format is an expression over the first and last bytes and can be
filtered on before any Python runs. Decoding is one Arrow function a batch; a file
that can't be decoded becomes a row with an error, never a failed job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.schemas import FRAMES, IMAGES

#: Images of more pixels become error rows: their RGBA wouldn't fit a cell or a worker.
MAX_PIXELS = 1 << 28


def files(spark: SparkSession, path: str, *, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of files under ``path``; Spark's scan leaves out empty files."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def byte_at(content: Column, at: int) -> Column:
    """An unsigned byte of a binary column, by zero-based place; null beyond its end."""
    one = F.hex(F.substring(content, at + 1, 1))
    return F.when(one != "", F.conv(one, 16, 10).cast("int"))


def word_at(content: Column, at: int) -> Column:
    """A little-endian number of two bytes."""
    return byte_at(content, at) + 256 * byte_at(content, at + 1)


def format_of(content: Column) -> Column:
    """The format by magic numbers; null if unknown. The first rule that holds wins."""
    head = F.hex(F.substring(content, 1, 12))
    size = F.octet_length(content)
    start = F.substring(content, 1, 4096)
    text = F.lower(F.decode(start, "ISO-8859-1"))
    at_svg, at_nul = F.instr(text, "<svg"), F.instr(text, "\0")
    svg = (at_svg > 0) & ((at_nul == 0) | (at_nul > at_svg))
    icons = word_at(content, 4)
    ico = head.rlike("^00000[12]00").__and__(F.substring(head, 1, 4) == "0000") & (size >= 6) & (icons > 0) & (size >= 6 + 16 * icons)
    depth = byte_at(content, 16).isin(0, 8, 15, 16, 24, 32)
    footer = F.hex(F.substring(content, -18, 18)) == "TRUEVISION-XFILE.\0".encode().hex().upper()
    kind, width, height = byte_at(content, 2), word_at(content, 12), word_at(content, 14)
    tga = (size >= 26) & footer | (size >= 18) & (byte_at(content, 1) <= 1) & (kind <= 11) & depth & ((kind == 0) | (width > 0) & (height > 0))
    return (
        F.when(ico, F.when(byte_at(content, 2) == 1, "ico").otherwise("cur"))
        .when(svg & (size >= 4), "svg")
        .when(head.startswith("89504E47") & (size >= 8), "png")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "gif")
        .when(head.startswith("424D"), "bmp")
        .when(head.rlike("^(49492A00|49492B00|4D4D002A|4D4D002B)"), "tiff")
        .when(tga, "tga")
        .when(head.startswith("255044462D"), "pdf")
        .when(head.startswith("52494646") & head.endswith("57454250"), "webp")
        .when(head.startswith("FFD8"), "jpeg")
    )


#: Endings of file names by format.
ENDINGS = {"jpg": "jpeg", "tif": "tiff"} | {n: n for n in ("svg", "png", "jpeg", "gif", "bmp", "tiff", "tga", "webp", "pdf", "ico", "cur")}


def format_of_name(path: Column) -> Column:
    """The format that a file's ending names, in any case; null if it names none."""
    pairs = F.create_map(*(F.lit(x) for pair in sorted(ENDINGS.items()) for x in pair))
    return F.try_element_at(pairs, F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1)))


#: Names of compression numbers in BMP headers, from 0.
BMP_COMPRESSIONS = ("RGB", "RLE8", "RLE4", "BITFIELDS", "JPEG", "PNG", "ALPHABITFIELDS")


def bmp_compression_name(number: Column) -> Column:
    return F.coalesce(F.get(F.array(*(F.lit(n) for n in BMP_COMPRESSIONS)), number.cast("int")), F.lit("UNKNOWN"))


def with_format(df: DataFrame, content: str = "content") -> DataFrame:
    """``df`` with ``format``, and an ``error`` for files that need no decoder to be refused."""
    known = format_of(F.col(content))
    error = F.when(F.octet_length(content) == 0, "empty file").when(known.isNull(), "unknown image format")
    return df.withColumns({"format": known, "error": error})


def decode_one(data: bytes, kind: str, page: int, **options):
    """One page of one file."""
    from pixelloom.sources.codecs import ImageError, bmp, gif, ico, jpeg, pdf, png, svg, tga, tiff, webp

    if kind in ("ico", "cur"):
        return ico.decode(data, page)
    if kind == "tiff":
        return tiff.decode(data, page)
    if kind == "pdf":
        return pdf.decode(data, page, trim=options.get("trim", True))
    if page:
        raise ImageError("page index out of range")
    if kind == "tga":
        return tga.decode(data, options.get("tga_corrections", True))
    if kind == "svg":
        names = ("width", "height", "scale", "dpi", "time", "supersampling", "background")
        return svg.decode(data, **{k: v for k, v in options.items() if k in names})
    decoders = {"bmp": bmp.decode, "png": png.decode, "gif": gif.decode, "jpeg": jpeg.decode, "webp": webp.decode}
    if kind not in decoders:
        raise ImageError(f"{kind} is not supported yet")
    return decoders[kind](data)


def page_count(data: bytes, kind: str) -> int:
    from pixelloom.sources.codecs import ico, pdf, tiff

    if kind == "pdf":
        return pdf.page_count(data)
    if kind in ("ico", "cur"):
        return len(ico.directory(data)[0])
    return len(tiff.pages(data)[1]) if kind == "tiff" else 1


def decode_images(df: DataFrame, *, page: int | str = 0, max_pixels: int = MAX_PIXELS, **options) -> DataFrame:
    """``images`` of rows (path, content): one page each, or every page if ``page`` is "all".

    A column ``format`` forces a decoder; without it the format is sniffed.
    """
    if "format" not in df.columns or "error" not in df.columns:
        df = with_format(df)

    def run(batches):
        kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.string()]
        names = ["path", "page", "format", "width", "height", "rgba", "hotspot_x", "hotspot_y", "error"]
        for batch in batches:
            for path, kind, content, error in zip(*(batch.column(k).to_pylist() for k in range(4))):
                rows = []
                try:
                    pages = [0] if error else range(page_count(content, kind)) if page == "all" else [page]
                except ValueError as e:
                    pages, error = [0], str(e)
                for p in pages:
                    try:
                        if error:
                            raise ValueError(error)
                        got = decode_one(content, kind, p, **options)
                        if got.width * got.height > max_pixels:
                            raise ValueError("image too large")
                        raw = None if got.rgba is None else got.rgba.tobytes()
                        rows.append((path, p, kind, got.width, got.height, raw, *got.hotspot, None))
                    except (ValueError, IndexError, OverflowError, MemoryError) as e:
                        rows.append((path, p, kind, None, None, None, None, None, str(e) or "decoding failed"))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return df.select("path", "format", "content", "error").mapInArrow(run, IMAGES)


def decode_frames(df: DataFrame) -> DataFrame:
    """``frames`` of rows (path, content): each frame of a GIF on the whole canvas."""

    def run(batches):
        from pixelloom.sources.codecs import gif

        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        names = ["path", "frame_no", "delay_ms", "user_input", "loop_count", "frame_count", "width", "height", "rgba", "error"]
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    a = gif.animation(content)
                    rows = [
                        (path, k, d, u, a.loops, len(a.frames), f.shape[1], f.shape[0], f.tobytes(), None)
                        for k, (f, d, u) in enumerate(zip(a.frames, a.delays, a.user_input))
                    ]
                except (ValueError, IndexError) as e:
                    rows = [(path, None, None, None, None, None, None, None, None, str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return df.select("path", "content").mapInArrow(run, FRAMES)


def icon_directory(df: DataFrame) -> DataFrame:
    """(path, entry, width, height, colors, planes, bitcount, size, offset, is_cursor), in expressions alone."""
    c = F.col("content")
    sane = F.hex(F.substring(c, 1, 4)).isin("00000100", "00000200") & (word_at(c, 4) > 0) & (F.octet_length(c) >= 6 + 16 * word_at(c, 4))
    each = df.where(sane).select("path", (byte_at(c, 2) == 2).alias("is_cursor"), "content", F.explode(F.sequence(F.lit(0), word_at(c, 4) - 1)).alias("entry"))
    record = F.hex(F.substr("content", F.col("entry") * 16 + 7, F.lit(16)))

    def number(at: int, size: int) -> Column:
        digits = F.concat(*(F.substring(record, 2 * (at + k) + 1, 2) for k in reversed(range(size))))
        return F.conv(digits, 16, 10).cast("long")

    def extent(at: int) -> Column:
        return F.when(number(at, 1) == 0, 256).otherwise(number(at, 1))

    return each.select(
        "path", "entry", extent(0).alias("width"), extent(1).alias("height"), number(2, 1).alias("colors"), number(4, 2).alias("planes"),
        number(6, 2).alias("bitcount"), number(8, 4).alias("size"), number(12, 4).alias("offset"), "is_cursor",
    )


def tiff_tags(df: DataFrame) -> DataFrame:
    """(path, ifd, tag, type, count, values) of every IFD entry with integer values."""

    def run(batches):
        from pixelloom.sources.codecs import tiff

        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, *t) for t in tiff.tags_of(content)]
                except (ValueError, IndexError):
                    continue
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "ifd", "tag", "type", "count", "values"])

    return df.select("path", "content").mapInArrow(run, "path string, ifd int, tag int, type int, count long, values array<long>")


def pdf_operators(df: DataFrame, page: int = 0) -> DataFrame:
    """(path, seq, op, args) of a page's content, operands as text; unreadable files give no rows."""

    def run(batches):
        from pixelloom.sources.codecs import pdf

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    found = list(pdf.operators(pdf.File(content).content(page)))
                except ValueError:
                    continue
                for k, (op, args) in enumerate(found):
                    rows.append((path, k, op, [a.decode("latin-1") if isinstance(a, bytes) else f"{a:g}" if isinstance(a, float) else str(a) for a in args]))
            if rows:
                kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "seq", "op", "args"])

    return df.select("path", "content").mapInArrow(run, "path string, seq int, op string, args array<string>")


def pdf_text(df: DataFrame) -> DataFrame:
    """(path, page, text, error) of every page."""

    def run(batches):
        from pixelloom.sources.codecs import pdf

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(path, k, pdf.text(content, k), None) for k in range(pdf.page_count(content))]
                except ValueError as e:
                    rows.append((path, None, None, str(e)))
            kinds = [pa.string(), pa.int32(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "page", "text", "error"])

    return df.select("path", "content").mapInArrow(run, "path string, page int, text string, error string")


def explode_pixels(images: DataFrame, key: str = "path") -> DataFrame:
    """(key, x, y, r, g, b, a) of decoded images, in Arrow batches of bounded size."""

    def run(batches):
        for batch in batches:
            for name, w, h, raw in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if raw is None:
                    continue
                px = np.frombuffer(raw, np.uint8).reshape(-1, 4).astype(np.int32)
                for a in range(0, len(px), 1 << 18):
                    part = px[a : a + (1 << 18)]
                    at = np.arange(a, a + len(part))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part), batch.schema.field(0).type), pa.array((at % w).astype(np.int32)), pa.array((at // w).astype(np.int32)), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(4))],
                        [key, "x", "y", "r", "g", "b", "a"],
                    )

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, "width", "height", "rgba").mapInArrow(run, f"`{key}` {kind}, x int, y int, r int, g int, b int, a int")


def assemble_pixels(px: DataFrame, key: str = "img") -> DataFrame:
    """Pixels back to (key, width, height, rgba), without Python."""

    def two(c: str) -> Column:
        return F.lpad(F.hex(c), 2, "0")

    cells = F.struct("y", "x", F.concat(*(two(c) for c in "rgba")).alias("h"))
    grouped = px.groupBy(key).agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.sort_array(F.collect_list(cells)).alias("cells"))
    return grouped.select(key, "width", "height", F.unhex(F.array_join(F.transform("cells", lambda c: c["h"]), "")).alias("rgba"))
