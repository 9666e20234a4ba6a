r"""Exact dedup: a log-structured merge index over text digests.

* A *memtable* is what one generation of the input holds: digests aggregated
  before the shuffle to one row each (count, smallest and largest row id).
* A *flush* writes a memtable as a run, each file sorted by digest and carrying
  Parquet's own Bloom filter and min/max statistics on the digest, so that a
  point lookup skips most files and row groups. Beside it lies the run's *filter*, a
  bitmap of at most 8 MB. A memtable is probed against the filters of all runs
  before: a digest that none of them may hold is new.
* *Compaction* merges a level's runs into one of the next level, once there are
  ``fan_in``. Digests that the probes left new in every run exist in one run only
  and are passed on as they are; the others are merged. It keeps the smallest
  identifier, or the largest, and a row per digest.
* *Hits*, digests of two rows or more, have their texts compared byte by byte:
  the smallest and the largest text of a digest must be the same string. A filter of
  the hits keeps other texts out of that shuffle. Digests of which the comparison
  fails are regrouped by the text itself.

All of it is DataFrame expressions. Aggregates combine before the shuffle, so a
digest with a third of all rows costs one row per task, and its rows find their
class by a broadcast of at most 999 rows (``common.even_join``). Filters that more digests than
cells saturate cost time, never results.

Defined results: null text counts as empty, and empty texts are copies of each
other; a null id sorts before all ids, and is null in keep_id where it stays; of a
class all rows with the id that stays are kept, so rows equal in id and text share
their fate; a text of any length is read whole; other columns, whatever their
names, are not read; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelloom.llm.common import even_join, file_system, filter_bits, filter_of, fresh_path, in_filter, lower_ascii, sift, stage

FILTERS = {
    "parquet.bloom.filter.enabled#digest": "true",
    "parquet.bloom.filter.adaptive.enabled": "true",
    "parquet.bloom.filter.max.bytes": str(1 << 20),
    "compression": "zstd",
}


#: Memtables that a table is dealt to, by its input partitions.
GENERATIONS = 4


class DigestIndex:
    """Runs of (digest, n, min_id, max_id, seen) under one folder of the shared store, with their filters.

    ``seen`` is false for a digest that no earlier run may hold. An index on a path that
    has runs already goes on with them. ``rows`` bounds the digests that filters are made for.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, rows: int = 1 << 20, fan_in: int = 4):
        self.spark, self.fan_in, self.bits = spark, fan_in, filter_bits(rows)
        self.path = path or fresh_path(spark, "digests")
        self.levels: dict[int, list[str]] = {}
        self.flushed = 0
        for level in self._list(self.path, "level="):
            runs = self._list(f"{self.path}/level={level}", "run=")
            self.levels[level] = [f"{self.path}/level={level}/run={r}" for r in runs]
            self.flushed = max(self.flushed, *(r + 1 for r in runs), 0)
        sizes = [int(x) for x in self._list(self.path, "bits=")]
        if sizes:
            self.bits = sizes[0]
        else:
            fs, at = file_system(spark, f"{self.path}/bits={self.bits}")
            fs.mkdirs(at)

    def _list(self, path: str, prefix: str) -> list[int]:
        fs, at = file_system(self.spark, path)
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))

    def _runs(self) -> list[str]:
        return [p for level in self.levels.values() for p in level]

    def _filter(self, name: str) -> DataFrame | None:
        """The filters of all runs, or of what was seen in them, as one."""
        runs = self._runs()
        if not runs:
            return None
        filters = self.spark.read.parquet(*(f"{p}/filter" for p in runs)).where(F.col("of") == name)
        return filters.groupBy("bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))

    def _write(self, rows: DataFrame, level: int) -> None:
        where = f"{self.path}/level={level}/run={self.flushed}"
        self.flushed += 1
        rows.sortWithinPartitions("digest").write.options(**FILTERS).parquet(f"{where}/rows")
        written = self.spark.read.parquet(f"{where}/rows")
        every = filter_of(written, "digest", self.bits).withColumn("of", F.lit("all"))
        every.unionByName(filter_of(written.where("seen"), "digest", self.bits).withColumn("of", F.lit("seen"))).write.parquet(f"{where}/filter")
        self.levels.setdefault(level, []).append(where)

    def flush(self, entries: DataFrame) -> None:
        """Write (digest, id) rows as a run of level 0; compact levels that are full."""
        memtable = entries.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(ordered("id")).alias("min_id"), F.max(ordered("id")).alias("max_id"))
        before = self._filter("all")
        probed = memtable.withColumn("__in", F.lit(False)) if before is None else in_filter(memtable, "digest", before, self.bits)
        self._write(probed.withColumnRenamed("__in", "seen"), 0)
        for level in sorted(self.levels):
            if len(self.levels[level]) >= self.fan_in:
                self._merge({level: self.levels[level]}, level + 1)

    def runs(self) -> DataFrame:
        return self.spark.read.parquet(*(f"{p}/rows" for p in self._runs()))

    def _merge(self, parts: dict[int, list[str]], level: int) -> None:
        """Merge runs into one of ``level``. What no probe met twice is passed on unshuffled."""
        paths = [p for runs in parts.values() for p in runs]
        rows = self.spark.read.parquet(*(f"{p}/rows" for p in paths))
        # Of two runs that hold a digest the later one has it as seen, in a run that may be of another level.
        marked = in_filter(rows, "digest", self._filter("seen"), self.bits)
        single = marked.where("not __in").select("digest", "n", "min_id", "max_id", "seen")
        merged = marked.where("__in").groupBy("digest").agg(
            F.sum("n").alias("n"), F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.max("seen").alias("seen")
        )
        for k in parts:
            del self.levels[k]
        self._write(single.unionByName(merged), level)

    def compact(self) -> DataFrame:
        """Merge every run into one of the next level and return it: a row per digest."""
        if len(self._runs()) > 1 or 0 in self.levels:
            self._merge(dict(self.levels), max(self.levels) + 1)
        return self.runs()

    def lookup(self, digests: list) -> DataFrame:
        """Rows of the named digests; statistics and Bloom filters skip the other files."""
        return self.runs().where(F.col("digest").isin(*digests))


NULL_ID = -(1 << 63)


def ordered(name: str) -> Column:
    """Ids in their order, null first."""
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID).cast("long"))


def exact_dedup(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    keep: str = "min",
    normalise=lower_ascii,
    digest=None,
    generations: int = GENERATIONS,
) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept and the text's SHA-256, which is also the digest unless one is given."""
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("id"), normalise(F.col(f"`{text}`")).alias("norm"))
    sha = F.unhex(F.sha2("norm", 256))
    named = rows.withColumn("sha", sha) if digest is None else rows.withColumns({"sha": sha, "digest": digest(F.col("norm"))})
    entries = named.drop("norm").withColumn("generation", F.pmod(F.spark_partition_id(), F.lit(generations)))
    entries = stage(entries, "entries", partition_by=["generation"])
    if digest is None:
        entries = entries.withColumn("digest", F.col("sha"))
    index = DigestIndex(spark, rows=entries.count())
    for k in range(generations):
        index.flush(entries.where(F.col("generation") == k).select("id", "digest"))
    compacted = index.compact()
    hits = compacted.where("n > 1").select("digest")

    # Byte verification: two texts of a digest that differ also differ as minimum and maximum.
    members = sift(rows.withColumn("digest", sha if digest is None else digest(F.col("norm"))), "digest", hits)
    extremes = members.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b"))
    broken = stage(extremes.where(F.col("a") != F.col("b")).select("digest"), "collisions")

    kept_id = F.col(f"{keep}_id").alias("keep_id")
    classes = compacted.select("digest", kept_id, F.col("n").alias("group_size"))
    entries = entries.select("id", "sha", "digest")
    counts = compacted.select("digest", "n")
    if broken.isEmpty():
        out = even_join(entries, classes, "digest", counts, "inner")
    else:
        # Digests that lied: group these few by the text itself, here by its SHA-256 beside the digest.
        out = even_join(entries.join(broken, "digest", "left_anti"), classes, "digest", counts, "inner")
        apart = members.join(broken, "digest", "left_semi").select("id", "digest", "norm")
        by_text = apart.groupBy("digest", "norm").agg(
            F.count(F.lit(1)).alias("group_size"), F.min(ordered("id")).alias("min_id"), F.max(ordered("id")).alias("max_id")
        )
        fixed = by_text.select(F.unhex(F.sha2("norm", 256)).alias("sha"), "digest", kept_id, "group_size")
        redone = entries.join(broken, "digest", "left_semi").join(fixed, ["digest", "sha"])
        out = out.unionByName(redone.select(out.columns))
    stays = F.when(F.col("keep_id") != NULL_ID, F.col("keep_id"))
    return out.select(
        F.col("id").alias("doc_id"),
        stays.alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        F.col("id").eqNullSafe(stays).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def weak_digest(bits: int):
    """A digest of few bits, for tests of the byte verification."""

    def of(norm: Column) -> Column:
        return F.unhex(F.lpad(F.hex(F.pmod(F.xxhash64(norm), F.lit(1 << bits))), 8, "0"))

    return of
