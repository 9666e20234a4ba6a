"""Mixing sources to target weights.

Tokens are added up per source; each source gets a repetition rate; a document is
then taken floor(rate) times, plus once more if a hash of its id falls below the
fraction. The hash makes reruns agree and needs no order, so emission is narrow.

Target allocation is water filling in closed form: with sources ordered by the
level at which they fill up (cap / weight), prefix sums of caps and suffix sums of
weights give the level for every possible set of full sources at once.

Defined results: null text has size 0; the null source is one source, ordered
last; a source without words has target 0; rows of equal id share a coin, so their copies
agree; rows without an id have coins by their text's digest, so they don't move a source together;
a text of any length is counted whole; other columns, whatever their names, are passed on by ``mix``
and not read by ``mixing_plan``; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import stage, word_count

WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_REPEATS = 2
#: Up to so many sources (some 5 MB of rows) the table of rates is broadcast; beyond, Spark joins by shuffle.
BROADCAST_SOURCES = 50_000


def allocate(sources: DataFrame, weights=WEIGHTS, share: float = TOTAL_SHARE, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size) to (source, source_size, target, rate). The table has a row per source."""
    first = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sources.withColumn(
        "weight",
        F.element_at(F.array(*(F.lit(int(w)).cast("long") for w in weights)), (F.row_number().over(first) - 1) % len(weights) + 1),
    )
    by_level = Window.orderBy(F.col("level"), F.col("source").isNull(), "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    after = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    leveled = (
        ranked.withColumn("cap", most * F.col("source_size"))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("water", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after))
        .withColumn("water", F.min(F.when(F.col("water") <= F.col("level"), F.struct("level", "water"))).over(everything)["water"])
    )
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("water"), F.lit(0.0)) * F.col("weight"))
    return leveled.select(
        "source",
        "source_size",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"),
    )


def coin(key: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by the key, a string, and the seed: 32 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def coin_key(key: Column, text: Column) -> Column:
    """What a row's coin hangs on: its id, or else its text's digest."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("text "), F.sha2(F.coalesce(text, F.lit("")), 256)))


def copies(rate: Column, key: Column, seed: int) -> Column:
    return (F.floor(rate) + (coin(key, seed) < rate - F.floor(rate)).cast("long")).cast("long")


def with_rates(sized: DataFrame, **options) -> DataFrame:
    """Join each row of (source, size, ...) to its source's size, target and rate."""
    sources = stage(
        allocate(sized.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")), **options), "rates"
    )
    rates = sources.withColumnRenamed("source", "rate_source")
    if sources.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    return sized.join(rates, sized["source"].eqNullSafe(rates["rate_source"])).drop("rate_source")


def mixing_plan(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **options
) -> DataFrame:
    """Per document: its size, its source's size and target, and the words the mix takes of it."""
    sized = stage(
        df.select(
            F.col(f"`{key}`").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            word_count(F.col(f"`{text}`")).alias("size"),
            coin_key(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("coin_key"),
        ),
        "sizes",
    )
    planned = with_rates(sized, **options)
    return planned.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies(F.col("rate"), F.col("coin_key"), seed)).alias("taken"),
    )


def mix(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 17, **options) -> DataFrame:
    """The mixed corpus itself: rows of ``df``, each as often as its rate says."""
    total = df.groupBy(F.col(f"`{source}`").alias("source")).agg(
        F.coalesce(F.sum(word_count(F.col(f"`{text}`"))), F.lit(0)).alias("source_size")
    )
    rates = stage(allocate(total, **options), "rates").select(F.col("source").alias("of"), "rate")
    if rates.count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    boxed = df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{source}`").alias("source"), coin_key(F.col(f"`{key}`"), F.col(f"`{text}`")).alias("coin_key")
    )
    joined = boxed.join(rates, F.col("source").eqNullSafe(F.col("of")))
    times = copies(F.col("rate"), F.col("coin_key"), seed).cast("int")
    # array_repeat of a constant, exploded: one row per copy, none where the mix takes none.
    return joined.select("row", F.explode(F.array_repeat(F.lit(True), times))).select(*(F.col("row")[c].alias(c) for c in df.columns))
