"""Sixel text of indexed pixels, as grouped bit sets and run lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.color import div
from pixelloom.operators.predictors import run_lengths

ESC = "\x1b"


def color_columns(indexed: DataFrame) -> DataFrame:
    """(img, band, idx, x, bits): which of a band's six rows have the colour in a column."""
    return indexed.groupBy("img", div(F.col("y"), 6).alias("band"), "idx", "x").agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), (F.col("y") % 6).cast("int"))).alias("bits")
    )


def color_lines(indexed: DataFrame, width: int) -> DataFrame:
    """(img, band, idx, line): each colour's run-length encoded columns in a band."""
    used = color_columns(indexed)
    # Columns without the colour are the gaps between those that have it: filled per colour and band.
    have = used.groupBy("img", "band", "idx").agg(F.map_from_entries(F.collect_list(F.struct("x", "bits"))).alias("m"))
    cells = have.select("img", "band", "idx", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"), "m")
    cells = cells.select("img", "band", "idx", "x", (F.coalesce(F.try_element_at("m", F.col("x")), F.lit(0)) + 63).alias("code"))
    runs = run_lengths(cells, ["img", "band", "idx"], "x", "code")
    text = F.when(F.col("n") > 3, F.concat(F.lit("!"), F.col("n").cast("string"), F.char("code"))).otherwise(F.repeat(F.char("code"), F.col("n").cast("int")))
    ordered = runs.groupBy("img", "band", "idx").agg(F.sort_array(F.collect_list(F.struct("first", text.alias("t")))).alias("parts"))
    return ordered.select("img", "band", "idx", F.array_join(F.transform("parts", lambda p: p["t"]), "").alias("line"))


def bands(lines: DataFrame) -> DataFrame:
    """(img, band, text): colours of a band in index order, each but the first after a carriage return."""
    parts = lines.groupBy("img", "band").agg(F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("p"))
    return parts.select("img", "band", F.array_join(F.transform("p", lambda p: F.concat(F.lit("#"), p["idx"], p["line"])), "$").alias("text"))


def palette_text(palette: list[tuple[int, int, int]]) -> str:
    return "".join(f"#{k};2;{r * 100 // 255};{g * 100 // 255};{b * 100 // 255}" for k, (r, g, b) in enumerate(palette))


def sixel(indexed: DataFrame, palette: list[tuple[int, int, int]], width: int, height: int) -> DataFrame:
    """(img, sixel) of images of one size that share a palette."""
    text = bands(color_lines(indexed, width)).groupBy("img").agg(F.sort_array(F.collect_list(F.struct("band", "text"))).alias("b"))
    head = f'{ESC}Pq"1;1;{width};{height}' + palette_text(palette)
    return text.select("img", F.concat(F.lit(head), F.array_join(F.transform("b", lambda b: b["text"]), "-"), F.lit(f"{ESC}\\\n")).alias("sixel"))


def encode(indices, palette: list[tuple[int, int, int]]) -> str:
    """The same text for one image with its own palette, in an Arrow function."""
    import numpy as np

    h, w = indices.shape
    out = []
    for top in range(0, h, 6):
        band = indices[top : top + 6]
        weight = (1 << np.arange(len(band)))[:, None]
        colors = []
        for k in np.unique(band).tolist():
            codes = ((band == k) * weight).sum(0) + 63
            at = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1], True])
            runs = zip(codes[at[:-1]].tolist(), np.diff(at).tolist())
            colors.append(f"#{k}" + "".join(f"!{n}{chr(c)}" if n > 3 else chr(c) * n for c, n in runs))
        out.append("$".join(colors))
    return f'{ESC}Pq"1;1;{w};{h}' + palette_text(palette) + "-".join(out) + f"{ESC}\\\n"


def encode_images(images: DataFrame, *, max_colors: int = 256, dither: str = "floyd-steinberg", background: int = 0xFFFFFF) -> DataFrame:
    """``images`` with ``sixel``: blended, quantised by octree, dithered and encoded, image by image."""
    import numpy as np
    import pyarrow as pa

    from pixelloom.operators.quantize import quantize

    def run(batches):
        bg = np.array([background >> 16 & 255, background >> 8 & 255, background & 255], np.int64)
        for batch in batches:
            texts = []
            for raw, w, h in zip(batch.column("rgba").to_pylist(), batch.column("width").to_pylist(), batch.column("height").to_pylist()):
                if raw is None or not w or not h:
                    texts.append(None)
                    continue
                px = np.frombuffer(raw, np.uint8).reshape(h, w, 4).astype(np.int64)
                a = px[..., 3:]
                rgb = np.where(a < 255, (px[..., :3] * a + bg * (255 - a)) // 255, px[..., :3])
                texts.append(encode(*quantize(rgb, max_colors, dither)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "sixel"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema) + ", sixel string"
    return images.mapInArrow(run, schema)


def shown_delay(delay_ms: Column) -> Column:
    """Frame delays below 20 ms play as 100."""
    return F.when(delay_ms < 20, 100).otherwise(delay_ms)


def animation(frames: DataFrame, **options) -> DataFrame:
    """(path, sixel, total_ms): one pass of the frames, cursor hidden, restored before each frame."""
    drawn = encode_images(frames, **options)
    parts = drawn.groupBy("path").agg(
        F.sort_array(F.collect_list(F.struct("frame_no", F.concat(F.lit(f"{ESC}8"), "sixel").alias("t")))).alias("p"),
        F.sum(shown_delay(F.col("delay_ms"))).alias("total_ms"),
    )
    text = F.concat(F.lit(f"{ESC}[?25l{ESC}7"), F.array_join(F.transform("p", lambda p: p["t"]), ""), F.lit(f"{ESC}[?25h"))
    return parts.select("path", text.alias("sixel"), "total_ms")
