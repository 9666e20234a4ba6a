"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_CH = "CAST(least(255, greatest(0, floor((CAST(embedding[4 * p + {k}] AS DOUBLE) + 0.4) / 0.8 * 255))) AS INTEGER)"
#: Tables of pixels that SQL may name: straight, premultiplied, and the next image's under this one's number.
TABLES = f"""
px AS (SELECT vec_id AS img, p % 4 AS x, p // 4 AS y, {_CH.format(k=1)} AS r, {_CH.format(k=2)} AS g, {_CH.format(k=3)} AS b, {_CH.format(k=4)} AS a
  FROM (SELECT vec_id, embedding, unnest(range(16)) AS p FROM embeddings)),
pm AS (SELECT img, x, y, r * a // 255 AS r, g * a // 255 AS g, b * a // 255 AS b, a FROM px),
pn AS (SELECT img - 1 AS img, x, y, r, g, b, a FROM pm)
"""
PIXEL = "img x y r g b a"


def query(name: str, columns: str, sql: str | None = None):
    """Register a query; its columns are cast to long here and in the SQL, but those after a ``:type``."""
    parts = [c.partition(":")[::2] for c in columns.split()]

    def wrap(make: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = make(spark, sf_dir)
            return df.select(*(F.col(c).cast(t or "long").alias(c) for c, t in parts))

        run.__doc__ = make.__doc__
        QUERIES[name] = run
        if sql is not None:
            kinds = {"": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
            casts = ", ".join(f"CAST({c} AS {kinds[t]}) AS {c}" for c, t in parts)
            head = "WITH RECURSIVE" if "RECURSIVE" in sql else "WITH"
            body = sql.replace("RECURSIVE", "").strip()
            ctes, _, last = body.rpartition("\n--\n")
            ORACLE[name] = f"{head} {TABLES}{', ' + ctes if ctes else ''} SELECT {casts} FROM ({last}) q"
        return run

    return wrap
