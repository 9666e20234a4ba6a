"""Print image files to a terminal: ``spark-submit pixelloom/cli.py FILE... [options]``.

Decoding and encoding run on the cluster; the driver only writes the text, in path order.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.operators.resample import fit
from pixelloom.sinks import ansi, kitty, sixel, terminal
from pixelloom.sources import images


def options(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="pixelloom", description=__doc__.splitlines()[0])
    p.add_argument("paths", nargs="+")
    p.add_argument("--fit", action="store_true", help="fit the terminal")
    p.add_argument("--ansi", action="store_true")
    p.add_argument("--sixel", action="store_true")
    p.add_argument("--sixel-colors", type=int, default=256)
    p.add_argument("--sixel-dither", choices=("none", "floyd-steinberg", "atkinson", "ordered"), default="floyd-steinberg")
    p.add_argument("--width", type=int, default=0)
    p.add_argument("--height", type=int, default=0)
    p.add_argument("--svg-time", type=float, default=0.0)
    p.add_argument("--pdf-page", type=int, default=1, help="counted from 1")
    return p.parse_args(argv)


def rendered(df: DataFrame, o: argparse.Namespace, backend: str) -> DataFrame:
    """(path, text) of decoded pages, or the file's error as text."""
    width, height = (terminal.fit_size() if o.fit else (o.width, o.height))
    page = F.when(F.col("format") == "pdf", F.lit(o.pdf_page - 1)).otherwise(0)
    known = images.with_format(df).withColumn("page", page)
    pdf = images.decode_images(known.where("format = 'pdf'").drop("page"), page=o.pdf_page - 1)
    rest = images.decode_images(known.where("format is null or format <> 'pdf'").drop("page"), time=o.svg_time)
    decoded = pdf.unionByName(rest)
    good = decoded.where("error is null and rgba is not null")
    if backend == "sixel":
        out = sixel.encode_images(good, max_colors=o.sixel_colors, dither=o.sixel_dither).select("path", F.col("sixel").alias("text"))
    elif backend == "kitty":
        out = kitty.still(good, columns=width, rows=height).select("path", F.col("kitty").alias("text"))
    else:
        px = images.explode_pixels(good).withColumnRenamed("path", "img")
        out = ansi.ansi_text(fit(px, width, height)).select(F.col("img").alias("path"), "text")
    bad = decoded.where("error is not null").select("path", F.concat(F.col("path"), F.lit(": "), F.col("error"), F.lit("\n")).alias("text"))
    return out.unionByName(bad)


def main(argv: list[str] | None = None) -> int:
    o = options(sys.argv[1:] if argv is None else argv)
    spark = SparkSession.builder.appName("pixelloom").getOrCreate()
    df = spark.read.format("binaryFile").load(o.paths)
    text = rendered(df, o, terminal.backend(os.environ, force_sixel=o.sixel, force_ansi=o.ansi))
    for row in text.orderBy("path").toLocalIterator():
        sys.stdout.write(row.text)
    return 0


if __name__ == "__main__":
    sys.exit(main())
