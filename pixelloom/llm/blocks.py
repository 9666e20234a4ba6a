"""Documents in blocks, and exchanges of keys between blocks and key ranges.

A block is one row with some megabytes of consecutive documents: ids, end offsets
and zstd-compressed UTF-8. Operators that must know what other documents hold work
by question and answer: each block sends its sorted distinct 64-bit keys, cut at
key-range borders, to the ranges; a range adds up what all blocks say of a key and
answers each block in the order it was asked. A key costs 6 to 8 bytes per block
that has it, however often it occurs there, so no key is hot. Keys that stand for
words may carry a proof, 64 more bits, and count as equal only if both are.

Beyond 2 x ``FAN`` blocks the exchange has two levels, so that rows stay full: blocks
ask ``FAN`` ranges; within a range the keys of up to ``FAN`` blocks are merged into
one unit, which asks ``FAN`` finer ranges; answers return the same way.

Blocks are written to the shared folder before anything depends on their numbers.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import textnum as tn
from pixelloom.llm.common import stage

BLOCK_BYTES = 5 << 20
ANSWER = "block long, range int, answer binary, figure_a long, figure_b long"


def bound_batches(spark) -> None:
    """Arrow batches are bounded by bytes, so blocks and long texts pass one or few at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def build(df: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``df``: (block, ids, ends, data), a written table."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        ids, ends, parts, size = [], [], [], 0

        def block():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([np.concatenate(ids).astype("<i8").tobytes()], pa.binary()),
                    pa.array([np.concatenate(ends).astype("<i8").tobytes()], pa.binary()),
                    pa.array([press.compress(b"".join(parts))], pa.binary()),
                ],
                ["block", "ids", "ends", "data"],
            )

        for batch in batches:
            for part in tn.parts_of(batch, 1, block_bytes // 4):
                data, offsets = tn.utf8(part.column(1))
                ids.append(part.column(0).to_numpy(zero_copy_only=False))
                ends.append(offsets[1:] + size)
                parts.append(data.tobytes())
                size += len(data)
                if size >= block_bytes:
                    yield block()
                    number += 1
                    ids, ends, parts, size = [], [], [], 0
        if ids:
            yield block()

    bound_batches(df.sparkSession)
    rows = df.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(-(1 << 63)).cast("long")), F.col(f"`{text}`"))
    return stage(rows.mapInArrow(run, "block long, ids binary, ends binary, data binary"), "blocks")


def opened(batch: pa.RecordBatch):
    """(block, ids, offsets, data) of each row of a batch of blocks."""
    import zstandard

    press = zstandard.ZstdDecompressor()
    for k in range(batch.num_rows):
        tn.free_encoders()
        ends = np.frombuffer(batch.column("ends")[k].as_buffer(), "<i8")
        yield (
            batch.column("block")[k].as_py(),
            np.frombuffer(batch.column("ids")[k].as_buffer(), "<i8"),
            np.concatenate([[0], ends]),
            np.frombuffer(press.decompress(batch.column("data")[k].as_buffer()), np.uint8),
        )
    tn.trim()


def slices(offsets: np.ndarray, most_bytes: int = 1 << 19):
    """(first document, last document) of parts of a block with at most so many bytes, or one longer document."""
    start = 0
    while start < len(offsets) - 1:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most_bytes, "right")) - 1)
        yield start, end
        start = end


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as steps of 6 bytes where they fit, else of 8."""
    steps = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    head = steps[:1].tobytes()
    rest = steps[1:]
    width = 6 if not len(rest) or int(rest.max()) < 1 << 48 else 8
    return bytes([width]) + head + rest.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_keys(raw) -> np.ndarray:
    raw = np.frombuffer(raw, np.uint8)
    if len(raw) < 9:
        return np.zeros(0, np.uint64)
    width, body = int(raw[0]), raw[9:]
    wide = np.zeros((len(body) // width + 1, 8), np.uint8)
    wide[0] = raw[1:9]
    wide[1:, :width] = body.reshape(-1, width)
    return np.cumsum(wide.reshape(-1).view("<u8"), dtype=np.uint64)


#: Ranges that a block or a unit asks, as a power of two.
FAN_BITS = 10
ASKED = "range int, block long, keys binary, said binary, proof binary"


def range_bits(blocks: DataFrame) -> int:
    """Log2 of the number of key ranges: about one range for two blocks."""
    return max(5, int(max(1, blocks.count()) / 2).bit_length())


def cuts(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(range, start, end) of the key ranges that sorted keys touch."""
    if not len(keys):
        return []
    ranges = keys >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
    return list(zip(ranges[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(keys)]))


def same_keys(keys: np.ndarray, proof: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, proofs, place of each input): distinct pairs of key and proof in ascending order."""
    distinct, first, where = np.unique(keys, return_index=True, return_inverse=True)
    if (proof[first][where] == proof).all():
        return distinct, proof[first], where
    order = np.lexsort((proof, keys))
    k, p = keys[order], proof[order]
    heads = np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1])]
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(heads) - 1
    return k[heads], p[heads], where


def asking(key_range: int, block: int, keys: np.ndarray, said: np.ndarray, proof: np.ndarray, press) -> tuple:
    """One row of ``ASKED``; a proof of zeros is left out."""
    shown = press.compress(proof.astype("<u8").tobytes()) if proof.any() else b""
    return key_range, block, pack_keys(keys), press.compress(said.tobytes()), shown


def asked_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["range", "block", "keys", "said", "proof"])


def ask(blocks: DataFrame, keys_of: Callable, bits: int, kind: str = "<u4") -> DataFrame:
    """Rows of ``ASKED``: ``keys_of(ids, offsets, data)`` gives ascending keys, a number for each, and perhaps proofs."""

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for block, ids, offsets, data in opened(batch):
                keys, said, *proof = keys_of(ids, offsets, data)
                said = said.astype(kind)
                proof = proof[0] if proof else np.zeros(len(keys), np.uint64)
                rows = [asking(r, block, keys[a:b], said[a:b], proof[a:b], press) for r, a, b in cuts(keys, bits)]
                if rows:
                    yield asked_batch(rows)

    return blocks.mapInArrow(run, ASKED)


def questions(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(keys, what was said, proofs, number of keys of each row) of rows of ``ASKED``."""
    import zstandard

    up = zstandard.ZstdDecompressor()
    keys = [unpack_keys(x.as_buffer()) for x in table.column("keys")]
    said = [np.frombuffer(up.decompress(x.as_buffer()), kind) for x in table.column("said")]
    proof = [
        np.frombuffer(up.decompress(x.as_buffer()), "<u8") if len(x.as_buffer()) else np.zeros(len(k), np.uint64) for x, k in zip(table.column("proof"), keys)
    ]
    return np.concatenate(keys), np.concatenate(said), np.concatenate(proof), np.array([len(k) for k in keys])


def answer(asked: DataFrame, judge: Callable, kind: str = "<u4") -> DataFrame:
    """Per question its answer. ``judge(keys, where, said)`` gets a range's distinct keys and,
    per question, the place of its key and what was said; it gives an answer for each key,
    and two figures to be added up over ranges."""

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        table = table.combine_chunks()
        keys, said, proof, sizes = questions(table, kind)
        distinct, _, where = same_keys(keys, proof)
        values, a, b = judge(distinct, where, said)
        said_back = values[where]
        ends = np.cumsum(sizes)
        blobs = [press.compress(said_back[e - n : e].tobytes()) for e, n in zip(ends, sizes)]
        n = table.num_rows
        return pa.table(
            {
                "block": table.column("block"),
                "range": table.column("range"),
                "answer": pa.array(blobs, pa.binary()),
                "figure_a": pa.array([a] + [0] * (n - 1), pa.int64()),
                "figure_b": pa.array([b] + [0] * (n - 1), pa.int64()),
            }
        )

    return asked.groupBy("range").applyInArrow(run, ANSWER)


def exchange(blocks: DataFrame, keys_of: Callable, judge: Callable, merge: Callable, kind: str, told: str, finer: int = 0) -> DataFrame:
    """Answers to the questions of all blocks, a written table: (block, range, answer, figure_a, figure_b).

    ``merge(n, where, said)`` says for each of n keys what several blocks said together, as one block might.
    ``told`` is the kind of the answers.
    """
    bits = range_bits(blocks) + finer
    if bits <= FAN_BITS + finer:
        return stage(answer(ask(blocks, keys_of, bits, kind), judge, kind), "answers")
    fan = 1 << FAN_BITS
    groups = -(-blocks.count() // fan)
    unit = F.col("range") * F.lit(groups).cast("long") + F.pmod(F.xxhash64("block"), F.lit(groups))
    asked = stage(ask(blocks, keys_of, FAN_BITS, kind).withColumn("unit", unit), "asked")
    bits = min(bits, 2 * FAN_BITS)

    def gather(table: pa.Table) -> pa.Table:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        keys, said, proof, _ = questions(table.combine_chunks(), kind)
        keys, proof, where = same_keys(keys, proof)
        said = merge(len(keys), where, said).astype(kind)
        number = table.column("unit")[0].as_py()
        return pa.Table.from_batches([asked_batch([asking(r, number, keys[a:b], said[a:b], proof[a:b], press) for r, a, b in cuts(keys, bits)])])

    back = stage(answer(asked.groupBy("unit").applyInArrow(gather, ASKED), judge, kind), "unit-answers")
    lists = back.groupBy(F.col("block").alias("unit")).agg(F.sort_array(F.collect_list(F.struct("range", "answer"))).alias("answers"))

    def spread(mine: pa.Table, given: pa.Table) -> pa.Table:
        import zstandard

        press, up = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        mine = mine.combine_chunks()
        keys, _, proof, sizes = questions(mine, kind)
        _, _, where = same_keys(keys, proof)
        parts = given.column("answers")[0].as_py()
        values = np.frombuffer(b"".join(up.decompress(p["answer"]) for p in parts), told)[where]
        ends = np.cumsum(sizes)
        none = pa.array([0] * mine.num_rows, pa.int64())
        blobs = pa.array([press.compress(values[e - n : e].tobytes()) for e, n in zip(ends, sizes)], pa.binary())
        return pa.table({"block": mine.column("block"), "range": mine.column("range"), "answer": blobs, "figure_a": none, "figure_b": none})

    returned = asked.groupBy("unit").cogroup(lists.groupBy("unit")).applyInArrow(spread, ANSWER)
    figures = back.groupBy().agg(F.sum("figure_a").alias("figure_a"), F.sum("figure_b").alias("figure_b"))
    nobody = figures.select(F.lit(None).cast("long").alias("block"), F.lit(None).cast("int").alias("range"), F.unhex(F.lit("")).alias("answer"), "figure_a", "figure_b")
    return stage(returned.unionByName(nobody), "answers")


def with_answers(blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Blocks beside the answers to their questions, in key order, as column ``answers``."""
    lists = answers.where("block is not null").groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "answer"))).alias("l"))
    return blocks.join(lists.select("block", F.transform("l", lambda x: x["answer"]).alias("answers")), "block", "left")


def answers_of(batch: pa.RecordBatch, k: int, kind) -> np.ndarray:
    """The answers for row ``k`` of a batch as one array, aligned with the keys the block asked for."""
    import zstandard

    up = zstandard.ZstdDecompressor()
    got = batch.column("answers")[k]
    if not got.is_valid:
        return np.zeros(0, kind)
    return np.frombuffer(b"".join(up.decompress(x.as_buffer()) for x in got.values), kind)
