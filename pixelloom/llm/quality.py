"""Quality rules: one projection compiled from a table of thresholds.

Every figure is a built-in expression over the row, so the whole operator is a
single narrow projection: no shuffle, no user function, and a long document costs
n log n in its own row. A null or empty text has no words and fails.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import let, words_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that for on with as by at it this from are was be or an a he not but "
    "der die das und zu den von mit ist des im für sich ein eine auf dem "
    "le la les de et des est un une que qui dans sur pour par au du en "
    "el los las y que se una con su para del al lo"
).split()


class Rule(NamedTuple):
    """A document of ``least_words`` or more fails if ``numerator / denominator`` leaves [low, high]."""

    name: str
    numerator: str
    denominator: str
    low: float | None
    high: float | None
    least_words: int = 0


#: The table that is compiled into the projection. Ratios are compared as products.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2.0, 16.0),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.25),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.01, None, 20),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """Words lying in a window that the text holds at least twice, each counted once.

    Texts whose windows have distinct 64-bit hashes, the usual case, have no repeat and
    leave after one distinct count. In the others windows are compared by their words.
    """

    def covered(starts: Column) -> Column:
        steps = F.transform(
            starts,
            lambda x, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1), x + window) - x).cast("long"),
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def starts_of(tagged: Column) -> Column:
        twins = F.filter(
            tagged,
            lambda x, k: (F.get(tagged, k - 1)["h"] == x["h"]) | (F.get(tagged, k + 1)["h"] == x["h"]),
        )
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    def of(w: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.size(w) - (window - 1))
        hashes = F.transform(starts, lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, window))))
        # Words hold no spaces, so joined words are the window itself.
        exact = F.array_sort(F.transform(starts, lambda x, i: F.struct(F.concat_ws(" ", x, *(F.get(w, i + j) for j in range(1, window))).alias("h"), i.alias("i"))))
        some = let(exact, lambda t: let(starts_of(t), covered))
        none = F.lit(0).cast("long")
        return F.when(F.size(w) < window + 1, none).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(some)))

    return let(words, of)


def measures(df: DataFrame, text: str = "text", stop_words=STOP_WORDS) -> DataFrame:
    """``df`` with the counts that rules refer to, all long."""
    body = F.coalesce(F.col(text), F.lit(""))
    forms = [F.lit(f) for w in sorted(set(stop_words)) for f in {w, w.capitalize()}]
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.size(F.filter(w, lambda x: x.isin(*forms))).cast("long").alias("n_stop_words"),
            repeated_window_words(w).alias("n_repeat_words"),
        )

    def line_counts(x: Column) -> Column:
        return F.struct(
            F.size(x).cast("long").alias("n_lines"),
            (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        )

    measured = df.withColumns(
        {
            "__words": let(words_of(body), counts),
            "__lines": let(lines, line_counts),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, SYMBOLS, ""))).cast("long"),
        }
    )
    return measured.select(
        *(F.col(f"`{c}`") for c in df.columns if c not in ("n_symbols",)), "n_symbols", "__words.*", "__lines.*"
    )


def passes(rules=RULES) -> Column:
    """True where every rule of the table holds. A zero denominator can't fail a rule."""
    tests = []
    for r in rules:
        top, below = F.col(r.numerator), F.col(r.denominator)
        exempt = F.col("n_words") < r.least_words
        if r.low is not None:
            tests.append(exempt | (top >= below * F.lit(r.low)))
        if r.high is not None:
            tests.append(exempt | (top <= below * F.lit(r.high)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def base_failed(min_words: int = 10, max_repeat_percent: int = 20) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def quality(df: DataFrame, *, text: str = "text", key: str = "doc_id", rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """Per document: its counts, ``base_failed`` and ``kept``.

    Nulls: a null text is empty, hence fails; a null key passes through. Repeated
    rows are judged alike. An empty table gives an empty result. Other columns of
    ``df`` are not read.
    """
    counted = measures(df.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("__text")), "__text", stop_words)
    return (
        counted.drop("__text")
        .withColumn("base_failed", base_failed())
        .withColumn("kept", ~F.col("base_failed") & passes(rules))
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_stop_words", "n_lines", "base_failed", "kept",
        )
    )


def keep_documents(df: DataFrame, *, text: str = "text", rules=RULES, stop_words=STOP_WORDS) -> DataFrame:
    """The rows of ``df`` that the base and the rules keep, with all their columns."""
    boxed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), F.col(f"`{text}`").alias("__text"))
    counted = measures(boxed, "__text", stop_words)
    return counted.where(~base_failed() & passes(rules)).select("__row.*")
