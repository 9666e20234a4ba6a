"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of applications that are marked for removal.
_ROOTS: set[str] = set()

#: Bytes that separate words: the complement of ``[^\x20\x09-\x0D]``.
WORD_BREAKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset on one machine, as in
    tests, a folder of our own is made, set, and removed at exit; on a cluster it must be set.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors of {master} share")
        local = tempfile.mkdtemp(prefix="pixelloom-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        place = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has used yet, in the application's part of the shared folder, which goes when it ends."""
    root = f"{shared_dir(spark)}/pixelloom-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        fs, path = file_system(spark, root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _ROOTS.add(root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a path."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), found


def stage(df: DataFrame, name: str, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that later plans start from files.

    Lost executors then cost a reread, never the work above the cut.
    """
    path = fresh_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.written_at = path
    return staged


def discard(*staged: DataFrame) -> None:
    """Delete the tables of ``stage`` that nothing will read again."""
    for df in staged:
        fs, path = file_system(df.sparkSession, df.written_at)
        fs.delete(path, True)


#: A key is hot if it has more than this share of all rows, so fewer than 1,000 keys are.
HOT_SHARE = 1000


def even_join(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, how: str = "left") -> DataFrame:
    """``left`` joined with ``right``, which has at most one row for a key, without a task that takes all of a key.

    ``counts`` is (key, n), the rows of ``left`` by key. Keys with more than 1 / ``HOT_SHARE`` of all
    rows are at most 999, so their rows of ``right`` are broadcast; the other keys are joined as ever.
    """
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") * HOT_SHARE > total).select(F.col(key).alias("__hot"))
    told = stage(hot.join(right, hot["__hot"] == right[key], "left").select("__hot", *(F.col(c).alias(f"__{c}") for c in right.columns if c != key)), "hot")
    values = [c for c in right.columns if c != key]
    if told.isEmpty():
        return left.join(right, key, how).select(*left.columns, *values)
    # At most 999 rows, whatever the input.
    marked = left.join(F.broadcast(told), left[key] == told["__hot"], "left")
    few = marked.where("__hot is not null").select(*left.columns, *(F.col(f"__{c}").alias(c) for c in values))
    rest = marked.where("__hot is null").select(*left.columns).join(right, key, how).select(*left.columns, *values)
    return few.unionByName(rest)


#: A filter has so many cells at most, as a power of two: 8 MB of bits.
FILTER_BITS = 26
#: Cells for each key that a filter is made for, as a power of two.
CELLS_PER_KEY = 4


def cell_of(key: Column, bits: int) -> Column:
    """The cell of a key, from 0."""
    return F.pmod(F.xxhash64(key), F.lit(1 << bits))


def filter_bits(keys: int) -> int:
    """How many cells a filter of so many keys gets, as a power of two."""
    return max(15, min(FILTER_BITS, max(1, keys).bit_length() + CELLS_PER_KEY))


def filter_of(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """A Bloom filter of one hash as rows (bucket, bitmap), 32,768 cells a row: at most 8 MB, whatever the input."""
    cells = keys.select((cell_of(F.col(key), bits) + 1).alias("cell"))
    return cells.groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bitmap"))


def in_filter(df: DataFrame, key: str, given: DataFrame, bits: int) -> DataFrame:
    """``df`` with a column ``__in``: whether the filter may hold the key; a key that it was made of always is."""
    given = F.broadcast(given.select(F.col("bucket").alias("__bucket"), F.col("bitmap").alias("__bitmap")))
    cell = cell_of(F.col(key), bits) + 1
    at = F.bitmap_bit_position(cell)
    byte = F.conv(F.hex(F.substring(F.col("__bitmap"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.expr("shiftright(__byte, __bit) & 1 = 1")
    marked = df.join(given, F.bitmap_bucket_number(cell) == F.col("__bucket"), "left").withColumns({"__byte": byte, "__bit": (at % 8).cast("int")})
    return marked.withColumn("__in", F.coalesce(bit, F.lit(False))).drop("__bucket", "__bitmap", "__byte", "__bit")


def sift(df: DataFrame, key: str, wanted: DataFrame, count: int | None = None) -> DataFrame:
    """Rows of ``df`` whose key may be in ``wanted`` (a column of the same name): all that are, and few others.

    Nothing is shuffled, so a join that follows moves little. With more keys than cells more others pass.
    """
    bits = filter_bits(wanted.count() if count is None else count)
    given = stage(filter_of(wanted, key, bits), "filter")
    return in_filter(df, key, given, bits).where("__in").drop("__in")


def digest_of(text: Column) -> Column:
    """SHA-256 of a text, 32 bytes; equal digests are equal texts. Null counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as an array; a null text has none."""
    flat = F.coalesce(text, F.lit(""))
    for c in WORD_BREAKS[1:]:
        flat = F.replace(flat, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(flat, " "), "")


def word_count(text: Column) -> Column:
    """How many words a text has, as a long."""
    return F.size(words_of(text)).cast("long")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    upper = "".join(map(chr, range(65, 91)))
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def own(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that other columns of a table can't clash with ours."""
    return df.select(*(F.col(f"`{n}`") for n in names))


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan, dealt to all cores if it has fewer splits than there are; a large one is left as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    splits = scan._jdf.queryExecution().toRdd().getNumPartitions()
    return scan if splits >= cores else scan.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
