"""New image files as a stream: each micro-batch decodes the files that arrived.

Files carry no event time, so there are no watermarks; a file is decoded once, and the
checkpoint remembers it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from pixelloom.sources import images

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, *, glob: str | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Files as they appear under ``path``."""
    reader = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def decode_to(files: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """Decode a stream of files into Parquet; ends when what is there has been read."""
    decoded = images.decode_images(images.with_format(files), **options)
    writer = decoded.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
