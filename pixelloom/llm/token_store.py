"""Token-id output into a content-addressed store.

A rolling hash over the last ids cuts each document's id stream where the content
says so, so equal passages give equal chunks wherever they start. The store holds
each distinct chunk once, addressed by a 128-bit BLAKE2b of its ids; documents are
recipes, lists of addresses, in ascending id order with running starts and a Merkle
root over their chunks. Reading back decodes each stored chunk once, checks it
against its address, and joins per-chunk figures to recipes: a document's CRC-32 is
the linear combination of its chunks' CRCs, so no payload is shuffled to verify it.

Files (Parquet): ``chunks`` has (address, doc_id, row, seq, n, payload); the payload,
zstd over little-endian ids of 2 or 4 bytes, is there on one row per address.
``recipes`` has (doc_id, start, n_tokens, merkle_root, addresses).

Defined results: null text is empty and holds the end id alone; rows that repeat a
doc_id are documents of their own, in any order among themselves; a null id sorts first; a
text of any length is encoded whole; other columns, whatever their names, are not read; no
rows give no rows.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixelloom.llm.common import even_join, fresh_path, stage
from pixelloom.llm.tokens import encoder, text_slices, tokenizer_path

ROLL, MASK_BITS, LEAST, MOST = 16, 10, 128, 8192
ADDRESS_BYTES = 16
#: Addresses a task remembers to leave out payloads it has already sent.
REMEMBERED = 200_000


def chunk_ends(docs: list[np.ndarray], roll: int = ROLL, bits: int = MASK_BITS, least: int = LEAST, most: int = MOST) -> list[list[int]]:
    """End positions of the chunks of each id stream, hashed in one pass over all of them.

    A cut needs ``least`` >= ``roll`` ids before it in its document, so no window that
    decides one reaches into the document before.
    """
    x = np.concatenate(docs).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    window = np.cumsum(x)  # sums wrap; a window's sum is a difference
    window[roll:] -= window[:-roll].copy()
    window *= np.uint64(0xBF58476D1CE4E5B9)
    cuts = np.flatnonzero((window >> np.uint64(64 - bits)) == 0) + 1
    stops = np.cumsum([len(d) for d in docs])
    first = np.searchsorted(cuts, np.r_[0, stops], "right").tolist()
    cuts, out, start = cuts.tolist(), [], 0
    for k, stop in enumerate(stops.tolist()):
        ends, last = [], start
        for c in [*cuts[first[k] : first[k + 1]], stop]:
            while c - last > most:
                last += most
                ends.append(last - start)
            if c - last >= least or c == stop and c > last:
                ends.append(c - start)
                last = c
        out.append(ends)
        start = stop
    return out


def pack_ids(ids: np.ndarray, compressor) -> bytes:
    """A chunk's payload: a width byte, then the compressed ids."""
    narrow = int(ids.max()) < 65536
    return (b"\x02" if narrow else b"\x04") + compressor.compress(ids.astype("<u2" if narrow else "<u4").tobytes())


def unpack_ids(payload: bytes, decompressor) -> np.ndarray:
    return np.frombuffer(decompressor.decompress(payload[1:]), "<u2" if payload[0] == 2 else "<u4").astype("<u4")


def chunked(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """(address, doc_id, row, seq, n, payload); a task sends each payload once."""

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        press = zstandard.ZstdCompressor(level=1)
        sent: set[bytes] = set()
        row = TaskContext.get().partitionId() << 40
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            for doc_ids, texts in text_slices(batch):
                out = []
                encoded = encoder(path).encode(texts)
                for i, ids, ends in zip(doc_ids.to_pylist(), encoded, chunk_ends(encoded)):
                    start = 0
                    for seq, end in enumerate(ends):
                        part = ids[start:end]
                        address = blake2b(part, digest_size=ADDRESS_BYTES).digest()
                        payload = None if address in sent else pack_ids(part, press)
                        sent.add(address)
                        out.append((address, i, row, seq, end - start, payload))
                        start = end
                    row += 1
                if len(sent) > REMEMBERED:
                    sent.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["address", "doc_id", "row", "seq", "n", "payload"]
                )

    return df.select(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`")).mapInArrow(
        run, "address binary, doc_id long, row long, seq int, n int, payload binary"
    )


def write_store(df: DataFrame, root: str, *, key: str = "doc_id", text: str = "text", path: str | None = None) -> None:
    """Encode ``df`` into a store under ``root``."""
    spark = df.sparkSession
    # Entries that came without a payload are spread, so a popular address gathers a row per task at most.
    spread = F.when(F.col("payload").isNull(), F.xxhash64("row", "seq"))
    first = Window.partitionBy("address", spread).orderBy("doc_id", "row", "seq")
    (
        chunked(df, key, text, path or tokenizer_path())
        .withColumn("payload", F.when(F.row_number().over(first) == 1, F.col("payload")))
        .write.option("compression", "lz4_raw")  # payloads are compressed already
        .parquet(f"{root}/chunks")
    )
    entries = spark.read.parquet(f"{root}/chunks").select("doc_id", "row", "seq", "n", "address")
    recipes = (
        entries.groupBy("doc_id", "row")
        .agg(F.sum("n").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("seq", "address"))).alias("parts"))
        .select("doc_id", "row", "n_tokens", F.transform("parts", lambda p: p["address"]).alias("addresses"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "row")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row")
        .withColumn("part", F.spark_partition_id())
    )
    recipes.write.option("compression", "zstd").parquet(f"{root}/ordered")
    ordered = spark.read.parquet(f"{root}/ordered")
    # One row per output partition: the starts of the parts.
    parts = ordered.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    (
        ordered.join(F.broadcast(parts), "part")
        .select(
            "doc_id",
            "row",
            (F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).alias("start"),
            "n_tokens",
            merkle_root(F.col("addresses")).alias("merkle_root"),
            "addresses",
        )
        .write.option("compression", "zstd")
        .parquet(f"{root}/recipes")
    )


def merkle_root(addresses, fan: int = 64):
    """A two-level hash tree in expressions: SHA-256 over groups of addresses, then over their digests."""
    groups = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(addresses) - 1) / fan).cast("int")),
        lambda g: F.sha2(F.unhex(F.array_join(F.transform(F.slice(addresses, g * fan + 1, F.lit(fan)), lambda a: F.hex(a)), "")), 256),
    )
    return F.sha2(F.unhex(F.array_join(groups, "")), 256)


def crc_shifters(bits: int = 48) -> np.ndarray:
    """Row k: the images of the 32 unit CRCs under appending 2**k zero bytes."""
    one = np.zeros(32, np.uint32)  # one zero bit
    one[0] = 0xEDB88320
    one[1:] = np.uint32(1) << np.arange(31, dtype=np.uint32)

    def through(m, v):
        out = np.zeros_like(v)
        for b in range(32):
            out ^= np.where((v >> np.uint32(b)) & np.uint32(1), m[b], np.uint32(0))
        return out

    for _ in range(3):
        one = through(one, one)
    rows = [one]
    for _ in range(bits - 1):
        rows.append(through(rows[-1], rows[-1]))
    return np.stack(rows)


def shift_crcs(crcs: np.ndarray, n_bytes: np.ndarray, shifters: np.ndarray) -> np.ndarray:
    """The CRC's share after ``n_bytes`` more bytes, for arrays at once."""
    out = crcs.astype(np.uint32)
    for k in range(int(n_bytes.max(initial=0)).bit_length()):
        on = np.flatnonzero((n_bytes >> k) & 1)
        v = out[on]
        moved = np.zeros_like(v)
        for b in range(32):
            moved ^= np.where((v >> np.uint32(b)) & np.uint32(1), shifters[k][b], np.uint32(0))
        out[on] = moved
    return out


def stored_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Decode every stored chunk: (address, chunk_n, crc); a chunk that doesn't hash to its address stops the job."""

    def run(batches):
        from zlib import crc32

        import zstandard

        press = zstandard.ZstdDecompressor()
        for batch in batches:
            addresses, ns, crcs = [], [], []
            for address, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = unpack_ids(payload, press)
                if blake2b(ids, digest_size=ADDRESS_BYTES).digest() != address:
                    raise ValueError(f"chunk {address.hex()} is damaged")
                addresses.append(address)
                ns.append(len(ids))
                crcs.append(crc32(ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(addresses, pa.binary()), pa.array(ns, pa.int32()), pa.array(crcs, pa.int64())], ["address", "chunk_n", "crc"]
            )

    stored = spark.read.parquet(f"{root}/chunks").where(F.col("payload").isNotNull())
    return stored.select("address", "payload").mapInArrow(run, "address binary, chunk_n int, crc long")


def insist(holds, what: str, doc_id):
    """A filter that keeps every row and stops the job at one for which ``holds`` isn't true."""
    told = F.concat(F.lit("document "), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(f": {what}"))
    return F.when(holds, F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))


def read_store(spark: SparkSession, root: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, merkle_root.

    Documents are rebuilt from their recipes' addresses. A missing or damaged chunk, and a
    root or a token count that differs from the recipe's, stop the job.
    """
    recipes = spark.read.parquet(f"{root}/recipes")
    sound = merkle_root(F.col("addresses")).eqNullSafe(F.col("merkle_root"))
    recipes = recipes.where(insist(sound, "its Merkle root differs", F.col("doc_id")))
    entries = recipes.select("doc_id", "row", F.posexplode("addresses").alias("seq", "address"))
    counts = stage(entries.groupBy("address").agg(F.count(F.lit(1)).alias("n")), "addresses")
    missing = F.raise_error(F.concat(F.lit("chunk "), F.hex("address"), F.lit(" is missing"))).cast("int")
    parts = (
        even_join(entries, stage(stored_chunks(spark, root), "stored"), "address", counts)
        .withColumn("chunk_n", F.when(F.col("chunk_n").isNull(), missing).otherwise(F.col("chunk_n")))
        .groupBy("doc_id", "row")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "chunk_n", "crc"))).alias("p"))
        .select("doc_id", "row", F.transform("p", lambda x: x["chunk_n"]).alias("ns"), F.transform("p", lambda x: x["crc"]).alias("crcs"))
    )

    def fold(batches):
        shifters = crc_shifters()
        for batch in batches:
            lists = batch.column(2)
            sizes = np.diff(lists.offsets.to_numpy())
            n = lists.flatten().to_numpy().astype(np.int64)
            crc = batch.column(3).flatten().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            totals = np.bincount(owner, n, len(sizes)).astype(np.int64)
            upto = np.cumsum(n)
            ends = np.cumsum(totals)
            moved = shift_crcs(crc, 4 * (ends[owner] - upto), shifters)
            heads = np.cumsum(sizes) - sizes
            folded = np.bitwise_xor.reduceat(moved, heads) if len(heads) else moved
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(totals), pa.array(folded.astype(np.int64))],
                ["doc_id", "row", "n_tokens", "ids_crc32"],
            )

    figures = parts.mapInArrow(fold, "doc_id long, row long, n_tokens long, ids_crc32 long")
    told = spark.read.parquet(f"{root}/recipes").select(
        F.col("doc_id").alias("recipe_id"), F.col("row").alias("recipe_row"), "start", F.col("n_tokens").alias("recipe_n"), "merkle_root"
    )
    same = figures["doc_id"].eqNullSafe(told["recipe_id"]) & (figures["row"] == told["recipe_row"])
    whole = insist(F.col("n_tokens").eqNullSafe(F.col("recipe_n")), "its number of tokens differs", F.col("doc_id"))
    return figures.join(told, same).where(whole).select("doc_id", "start", "n_tokens", "ids_crc32", "merkle_root")


def token_store(df: DataFrame, *, root: str | None = None, **options) -> DataFrame:
    """Write a store and return what reading it back gives."""
    root = root or fresh_path(df.sparkSession, "token-store")
    write_store(df, root, **options)
    return read_store(df.sparkSession, root)
