r"""Chat formatting by relational expressions, reversible.

Turns of a conversation are collected as structs, sorted, and adjacent turns of
one role are merged with array aggregation into one block, their texts joined by a
continuation mark. A block is ``<|role|>ROLE<|text|>TEXT<|end|>``. Inside texts and
roles the marks' opening ``<|`` is escaped as ``<\|``, and a run of backslashes
after ``<`` that ends in ``|`` grows by one, so unescaping removes exactly one.
Beside the text goes the mask: where each block's text lies, in code points, and
whether it is learned. Only blocks of the assistant are.

The collected group is one conversation, which becomes one output row and so has
to fit a row in any engine; Spark deals conversations out by id.

Defined results: null text and null role count as empty; null turns sort first;
turns that tie are ordered by role, then text, both as they are before escaping; equal
rows are turns of their own; a null id is one conversation; a text of any length is
formatted whole; other columns, whatever their names, are not read; no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelloom.llm.common import let

ROLE, TEXT, MORE, END = "<|role|>", "<|text|>", "<|more|>", "<|end|>"


def escape(text: Column) -> Column:
    r"""``<`` + n backslashes + ``|`` gets one backslash more; nothing else changes."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def running(values: Column, part: int = 256) -> Column:
    """Sums of an array of longs up to and with each place: sums of parts, then within the part."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)

    def of(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / part).cast("int")), lambda c: total(F.slice(v, c * part + 1, F.lit(part))))
        bases = let(parts, lambda t: F.transform(t, lambda _, c: total(F.slice(t, F.lit(1), c))))
        return let(bases, lambda b: F.transform(v, lambda _, i: F.get(b, F.floor(i / part).cast("int")) + total(F.slice(v, i - i % part + 1, i % part + 1))))

    return let(values, of)


def merged(turns: Column) -> Column:
    """Sorted turns as blocks: adjacent turns of a role become one struct (role, texts), escaped."""
    places = F.sequence(F.lit(0), F.size(turns) - 1)
    heads = F.filter(places, lambda i: (i == 0) | (F.get(turns, i - 1)["role"] != F.get(turns, i)["role"]))

    def block(heads: Column) -> Column:
        return F.transform(
            heads,
            lambda h, k: F.struct(
                escape(F.get(turns, h)["role"]).alias("role"),
                F.array_join(
                    F.transform(F.slice(turns, h + 1, F.coalesce(F.get(heads, k + 1), F.size(turns)) - h), lambda t: escape(t["text"])), MORE
                ).alias("body"),
            ),
        )

    return let(heads, block)


def format_chats(
    df: DataFrame, *, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant"
) -> DataFrame:
    """One row per conversation: conv_id, its formatted text, and the mask: (start, length, learned) of each block's text."""
    turns = df.select(
        F.col(f"`{key}`").alias("conv_id"),
        F.struct(
            F.col(f"`{turn}`").alias("turn"),
            F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    collected = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))

    def laid_out(blocks: Column) -> Column:
        around = len(ROLE) + len(TEXT) + len(END)
        lengths = F.transform(blocks, lambda b: (F.length(b["role"]) + F.length(b["body"]) + around).cast("long"))
        spans = let(
            running(lengths),
            lambda ends: F.zip_with(
                blocks,
                ends,
                lambda b, e: F.struct(
                    (e - len(END) - F.length(b["body"])).cast("long").alias("start"),
                    F.length(b["body"]).cast("long").alias("length"),
                    (b["role"] == escape(F.lit(learn))).alias("learned"),
                ),
            ),
        )
        whole = F.array_join(F.transform(blocks, lambda b: F.concat(F.lit(ROLE), b["role"], F.lit(TEXT), b["body"], F.lit(END))), "")
        return F.struct(whole.alias("formatted"), spans.alias("mask"))

    out = let(F.col("ts"), lambda ts: let(merged(ts), laid_out))
    return collected.select("conv_id", out.alias("out")).select("conv_id", "out.formatted", "out.mask")


def parse_chats(formatted: DataFrame) -> DataFrame:
    """Read blocks back: conv_id, formatted, mask, and the blocks as array<struct<role, texts, start, length>>."""
    bodies = F.filter(F.split("formatted", r"<\|end\|>"), lambda b: F.length(b) > 0)
    blocks = F.transform(
        bodies,
        lambda b: F.struct(
            unescape(F.replace(F.substring_index(b, TEXT, 1), F.lit(ROLE), F.lit(""))).alias("role"),
            F.transform(F.split(F.substring_index(b, TEXT, -1), r"<\|more\|>"), unescape).alias("texts"),
            F.length(b).cast("long").alias("chars"),
            F.length(F.substring_index(b, TEXT, -1)).cast("long").alias("length"),
        ),
    )

    def placed(blocks: Column) -> Column:
        ends = running(F.transform(blocks, lambda b: b["chars"] + len(END)))
        return F.zip_with(blocks, ends, lambda b, e: b.withField("start", e - len(END) - b["length"]))

    return formatted.select("conv_id", "formatted", "mask", let(blocks, placed).alias("blocks"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Figures of the formatted text and its mask, each taken from the parse; a mask that isn't on a block's text stops the job."""

    def learned(b: Column, m: Column) -> Column:
        fits = (b["start"] == m["start"]) & (b["length"] == m["length"])
        said = F.when(m["learned"], F.array_join(b["texts"], "")).otherwise(F.lit(""))
        return F.when(fits, said).otherwise(F.raise_error(F.lit("the mask doesn't lie on the texts")).cast("string"))

    turns = F.flatten(F.transform("blocks", lambda b: F.transform(b["texts"], lambda t: F.concat(b["role"], F.lit("\n"), t, F.lit("\n")))))
    return (
        parse_chats(formatted)
        .select(
            "conv_id",
            let(turns, lambda t: F.struct(F.size(t).cast("long").alias("n_turns"), F.sha2(F.array_join(t, ""), 256).alias("turns_sha256"))).alias("t"),
            F.array_join(F.zip_with("blocks", "mask", learned), "").alias("under"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )
        .select(
            "conv_id",
            "t.n_turns",
            "t.turns_sha256",
            F.length("under").cast("long").alias("loss_chars"),
            F.sha2("under", 256).alias("loss_sha256"),
            "formatted_chars",
        )
    )
