"""Tables about vector documents and metadata, without drawing them."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.functions.svg import clock_seconds, length, repeat_count
from pixelloom.sources.images import decode_images


def text_of(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def attribute(tag: Column, name: str) -> Column:
    """A quoted attribute of a tag's text, by name without case or prefix; null if it isn't there."""
    pattern = rf"(?is)(?:^|[\s:]){name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    return F.when(tag.rlike(pattern), F.concat(F.regexp_extract(tag, pattern, 1), F.regexp_extract(tag, pattern, 2)))


def svg_dimensions(df: DataFrame) -> DataFrame:
    """(path, width, height) by attributes of the svg element, else its view box, else 512; expressions alone."""
    root = F.regexp_extract(text_of(F.col("content")), r"(?is)<(?:\w+:)?svg\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", 1)
    tags = df.select("path", root.alias("tag"))
    box = F.transform(F.regexp_extract_all(F.coalesce(attribute(F.col("tag"), "viewBox"), F.lit("")), F.lit(r"[-+.\d]+(?:[eE][-+]?\d+)?"), F.lit(0)), lambda v: v.try_cast("double"))
    tags = tags.withColumn("box", box)
    sides = []
    for name, k in (("width", 2), ("height", 3)):
        said = length(attribute(F.col("tag"), name))
        sides.append(F.coalesce(said, F.when(F.size("box") == 4, F.get("box", F.lit(k))), F.lit(512.0)).alias(name))
    return tags.select("path", *sides)


def svg_tags(df: DataFrame) -> DataFrame:
    """(path, seq, depth, tag, attrs) of every element in document order."""

    def run(batches):
        from pixelloom.sources.codecs import svg

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    stack = [(0, svg.parse(content))]
                except ValueError:
                    continue
                seq = 0
                while stack:
                    depth, node = stack.pop()
                    rows.append((path, seq, depth, node.tag, list(node.attrs.items())))
                    seq += 1
                    stack += [(depth + 1, c) for c in reversed(node.children)]
            if rows:
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string())]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["path", "seq", "depth", "tag", "attrs"])

    return df.select("path", "content").mapInArrow(run, "path string, seq int, depth int, tag string, attrs map<string,string>")


def svg_timeline(df: DataFrame) -> DataFrame:
    """(path, duration_s, indefinite): how long a document's animations play.

    The latest end of its animate and set elements and of CSS ``animation:`` shorthands,
    2 seconds if that is at most 0.05. Documents without an animation are left out.
    """
    text = df.select("path", text_of(F.col("content")).alias("text"))
    tags = text.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)<\s*((?:animate|set)\w*(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"), F.lit(1))).alias("tag"))
    dur = F.when(attribute(F.col("tag"), "dur").isNull(), 0.001).otherwise(F.coalesce(clock_seconds(attribute(F.col("tag"), "dur")), F.lit(0.0)))
    smil = tags.select(
        "path",
        F.coalesce(clock_seconds(attribute(F.col("tag"), "begin")), F.lit(0.0)).alias("begin"),
        dur.alias("dur"),
        F.coalesce(repeat_count(attribute(F.col("tag"), "repeatCount")), F.lit(1.0)).alias("times"),
    )
    shorthand = text.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"(?is)animation:\s*((?:\([^)]*\)|[^;}(])*)"), F.lit(1))).alias("v"))
    words = F.split(F.lower(F.regexp_replace("v", r"\([^)]*\)", "")), r"\s+")
    clocks = F.filter(words, lambda w: w.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)m?s$"))
    numbers = F.filter(words, lambda w: w.rlike(r"^(\d+\.?\d*|\.\d+)$"))
    css = shorthand.select(
        "path",
        F.coalesce(clock_seconds(F.get(clocks, F.lit(1))), F.lit(0.0)).alias("begin"),
        clock_seconds(F.get(clocks, F.lit(0))).alias("dur"),
        F.when(F.array_contains(words, "infinite"), F.lit(float("inf"))).otherwise(F.coalesce(F.get(numbers, F.lit(0)).cast("double"), F.lit(1.0))).alias("times"),
    ).where("dur > 0")
    every = smil.unionByName(css)
    endless = F.col("times") == float("inf")
    stop = F.max(F.when(~endless, F.col("begin") + F.col("dur") * F.col("times")))
    return every.groupBy("path").agg(F.when(stop > 0.05, stop).otherwise(2.0).alias("duration_s"), F.bool_or(endless).alias("indefinite"))


def svg_frames(df: DataFrame, *, fps: float = 30.0, most_s: float | None = None, **options) -> DataFrame:
    """(path, t, width, height, rgba, error): documents drawn at every sample time of their timeline.

    A row is a (document, time) pair, so an animation is drawn by many tasks. An endless
    timeline is drawn once through; ``most_s`` ends longer ones early, and none does by default.
    """
    lengths = svg_timeline(df)
    shown = F.col("duration_s") if most_s is None else F.least(F.col("duration_s"), F.lit(most_s))
    steps = F.floor(shown * fps).cast("int")
    times = lengths.select("path", F.explode(F.sequence(F.lit(0), steps)).alias("k"))
    jobs = df.select("path", "content").join(times, "path").select("path", (F.col("k") / fps).alias("t"), "content")

    def run(batches):
        from pixelloom.sources.codecs import svg

        for batch in batches:
            for path, t, content in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    got, error = svg.decode(content, time=t, **options), None
                except ValueError as e:
                    got, error = None, str(e)
                row = (path, t, got and got.width, got and got.height, got and got.rgba.tobytes(), error)
                kinds = [pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["path", "t", "width", "height", "rgba", "error"])

    return jobs.mapInArrow(run, "path string, t double, width int, height int, rgba binary, error string")


TGA = "path string, author string, comments string, job string, software string, gamma_num int, gamma_den int, attributes int, thumb_width int, thumb_height int, thumbnail binary"


def tga_metadata(df: DataFrame) -> DataFrame:
    """Fields of the extension area and the thumbnail of TGA files that have one."""

    def run(batches):
        from pixelloom.sources.codecs import tga

        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    e, small = tga.extension(content), tga.thumbnail(content)
                except ValueError:
                    continue
                if e:
                    rows.append((path, e["author"], e["comments"], e["job"], e["software"], *e["gamma"], e["attributes"], small and small.width, small and small.height, small and small.rgba.tobytes()))
            if rows:
                kinds = [pa.string()] * 5 + [pa.int32()] * 5 + [pa.binary()]
                names = [c.split()[0] for c in TGA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return df.select("path", "content").mapInArrow(run, TGA)


def largest_icon(df: DataFrame) -> DataFrame:
    """Each icon file's page of most pixels, decoded."""
    pages = decode_images(df, page="all").where("error is null")
    best = F.max_by(F.struct("page", "format", "width", "height", "rgba", "hotspot_x", "hotspot_y", "error"), F.struct(F.col("width") * F.col("height"), -F.col("page")))
    return pages.groupBy("path").agg(best.alias("b")).select("path", "b.*")
