"""Best-fit packing, planned on the histogram of lengths.

Documents become ids and longer ones are cut; pieces carry their ids to their place. The
histogram has at most ``capacity`` rows, so best fit decreasing runs over counts on
the driver in time that doesn't depend on the number of documents. Its plan is a
list of slot runs, "the pieces of length L and rank r in [a, b) lie at offset o of
sequences s, s+1, ...". Pieces find their slot by joining on their rank within length.
Pieces of a whole sequence are numbered where they are made and need no plan. The
others are ranked within (length, salt) and shifted by prefix counts; a length has a salt
for every ``SALTED`` pieces or more, so one that a third of all pieces share is ranked by many tasks.

Defined results: null text is empty, so one end id; a null id sorts first; repeated rows
are packed each, and pieces that tie in id and number are ranked by their ids' CRC, equal
ones in any order; a text of any length is encoded whole; other columns, whatever their
names, are not read; an empty table gives none.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import stage
from pixelloom.llm.tokens import encoder, text_slices, tokenizer_path

CAPACITY = 1024
#: Pieces of a length for which it gets one more salt, and most salts of all lengths together.
SALTED, MOST_SALTS = 50_000, 50_000
#: Numbers of sequences that one piece fills begin here.
FULL = 1 << 62
#: What the queries return of a packed piece: its ids as their CRC-32.
PLACES = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what doesn't fill a sequence."""
    first = n % capacity
    cuts = [(0, first)] if first else []
    return cuts + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(df: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Encode ``df`` and cut it: (doc_id, piece, start, length, full, ids), ids as little-endian uint32.

    ``full`` is the number of a sequence of its own for a piece of ``capacity`` ids, else null."""
    path = path or tokenizer_path()

    def encode(batches):
        from pyspark import TaskContext

        number = FULL + (TaskContext.get().partitionId() << 36)
        for batch in batches:
            for ids, texts in text_slices(batch):
                rows = []
                for i, x in zip(ids.to_pylist(), encoder(path).encode(texts)):
                    for p, (s, n) in enumerate(cut_points(len(x), capacity)):
                        rows.append((i, p, s, n, number if n == capacity else None, x[s : s + n].tobytes()))
                        number += n == capacity
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                    ["doc_id", "piece", "start", "length", "full", "ids"],
                )

    return df.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(
        encode, "doc_id long, piece int, start long, length long, full long, ids binary"
    )


def plan_best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best fit decreasing over {length: count}.

    Returns slot runs (length, first rank, number, first sequence, offset); runs of a
    length cover its ranks 0..count-1. Bins of equal history stay together as a span
    of consecutive sequence numbers, so work follows the number of distinct lengths.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    spans: dict[int, list[tuple[int, int]]] = {}  # room left -> [(first sequence, number)]
    rooms: list[int] = []
    fresh = 0

    def give(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in spans:
                insort(rooms, room)
                spans[room] = []
            spans[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = spans[room].pop()
                if not spans[room]:
                    del spans[room], rooms[at]
            else:
                room, first = capacity, fresh
                number = -(-left // (capacity // length))
                fresh += number
            # Best fit fills a bin with this length before it touches the next one.
            each = room // length
            full, over = divmod(left, each)
            full = min(full, number)
            for k in range(each if full else 0):
                slots.append((length, rank, full, first, capacity - room + k * length))
                rank += full
            left -= full * each
            give(room - each * length, first, full)
            if full < number and left:
                over = min(left, each)
                for k in range(over):
                    slots.append((length, rank, 1, first + full, capacity - room + k * length))
                    rank += 1
                left -= over
                give(room - over * length, first + full, 1)
                full += 1
            give(room, first + full, number - full)
    return slots


def local_table(spark: SparkSession, rows: list[tuple], kinds: dict[str, pa.DataType]) -> DataFrame:
    """A DataFrame of the driver's rows by way of Arrow; from a list executors would start three more Python processes each."""
    columns = zip(*rows) if rows else [[]] * len(kinds)
    return spark.createDataFrame(pa.table([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds)))


def ranked_by(df: DataFrame, column: str, order: list[str], counts: dict[int, int]) -> DataFrame:
    """``df`` with ``rank``, 0.. within each value of ``column``, without a task per value; ``counts`` has the rows of each."""
    each = max(SALTED, sum(counts.values()) // MOST_SALTS)
    salts = local_table(df.sparkSession, [(int(v), -(-n // each)) for v, n in counts.items()], {"__value": pa.int64(), "__salts": pa.int32()})
    # A row for each value, of which there are at most as many as lengths.
    salted = df.join(F.broadcast(salts), F.col(column) == F.col("__value")).withColumn("__salt", F.pmod(F.xxhash64(*order), F.col("__salts")).cast("int"))
    sizes = salted.groupBy(column, "__salt").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(column).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(column, "__salt", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    within = Window.partitionBy(column, "__salt").orderBy(*order)
    # At most MOST_SALTS and a row for each value, whatever the input: some 1.5 MB.
    return (
        salted.withColumn("__rank", F.row_number().over(within) - 1)
        .join(F.broadcast(shifts), [column, "__salt"])
        .withColumn("rank", F.col("__rank") + F.col("__shift"))
        .drop("__value", "__salts", "__salt", "__rank", "__shift")
    )


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give rows of (doc_id, piece, length, tie, ...) a sequence_id and an offset."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan_best_fit(histogram, capacity)
    # The plan grows with the number of distinct lengths (at most ``capacity``), not with the pieces.
    names = ["slot_length", "first_rank", "number", "first_sequence", "offset"]
    plan = local_table(spark, slots, dict.fromkeys(names, pa.int64()))
    ranked = ranked_by(pieces, "length", ["doc_id", "piece", "tie"], histogram)
    hit = (
        (F.col("length") == F.col("slot_length"))
        & (F.col("rank") >= F.col("first_rank"))
        & (F.col("rank") < F.col("first_rank") + F.col("number"))
    )
    return ranked.join(F.broadcast(plan), hit).select(
        *pieces.columns, (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset"
    )


def pack(df: DataFrame, *, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pack every document: a row per piece with its ids, their CRC-32 and its place."""
    pieces = stage(token_pieces(df, key=key, text=text, path=path, capacity=capacity), "pieces")
    # Ties are ranked by a CRC; what is returned is taken from the ids that arrived.
    placed = place(pieces.where("full is null").drop("full").withColumn("tie", F.crc32("ids")), capacity)
    whole = pieces.where("full is not null").withColumns({"sequence_id": F.col("full"), "offset": F.lit(0).cast("long")})
    columns = ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"]
    return placed.select(*columns).unionByName(whole.select(*columns)).withColumn("ids_crc32", F.crc32("ids")).select(*PLACES, "ids")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences of ``pack``'s rows: (sequence_id, n_tokens, ids), the pieces' ids in order of offset."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    # Arrays of strings join, arrays of bytes don't, so bytes pass as hex digits.
    joined = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
        .select("sequence_id", "n_tokens", joined.alias("ids"))
    )
