"""MinHash near-dedup by BagMinHash over word-shingle multisets.

A text is a bag: its 5-word shingles with their counts. For every shingle runs a
Poisson process over time and weight; a point below the shingle's count enters a
register if it comes earlier than what the register holds. Weights are discretised
at integers and halved into dyadic intervals [0,1), [1,2), [2,4), [4,8) and so on,
each with a process of its own, whose points descend by the bits of one hash. So
shingles of count 1, nearly all, cost one process, and a count c costs log c of them.
Two texts agree in a register with probability sum(min)/sum(max), exactly.

Texts whose registers agree in a whole band become a group, groups become classes
(``linking``): two texts are linked if they share a band and their multisets overlap by
the threshold, whatever the size of a group. A compared pair first has all its registers
counted: one at 0.8 agrees in fewer than 0.8 - 6 standard deviations of them with
probability 1e-9, so only pairs above that fetch their texts, which are verified by their
words. Byte-equal texts are one node from the start. Large groups that rounds of
draws leave open are settled in blocks by matrix products (``links_of_families``), so a large
family just below the threshold makes few rows; its work still follows the square of its size.

With 32 bands of 7 registers a pair at similarity 0.8 shares a band with probability
1 - (1 - 0.8^7)^32 = 0.9995, and one at 0.2, such as two short texts with the same
heading, with 0.0004.

Every interval's process runs flat to a horizon that fills all registers with high
probability, and further if it didn't, in place of a tree of splits.

Defined results: a text without words (null, empty) is alone and stays; a text of
one to four words has one shingle; of a class the row stays that is smallest by id,
null before all, then by the text's digest, so rows of one id and different texts are
told apart, and rows equal in both share their fate; a text of any length is compared
whole; other columns, whatever their names, are not read; an empty table gives none.
A null id is held as the smallest 64-bit number, so a row with that id counts as one without.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import textnum as tn
from pixelloom.llm.common import digest_of, even_join, sift, stage
from pixelloom.llm.linking import components, link

BANDS, ROWS = 32, 7
SIZE, THRESHOLD = 5, 0.8
KEY_BITS = 44
#: Texts in a block of a family.
BLOCK = 128
NULL_ID = -(1 << 63)


def bags(data: np.ndarray, offsets: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle key of 44 bits, count), ordered by text."""
    starts, ends, owner = tn.words(data, offsets)
    h, of = tn.shingles(tn.span_hashes(data, starts, ends), owner, len(offsets) - 1, size)
    keys = np.sort((of.astype(np.uint64) << np.uint64(KEY_BITS)) | (h >> np.uint64(64 - KEY_BITS)))
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    keys, counts = keys[heads], np.diff(np.r_[heads, len(keys)])
    return (keys >> np.uint64(KEY_BITS)).astype(np.int64), keys & np.uint64((1 << KEY_BITS) - 1), counts


def signatures(of: np.ndarray, keys: np.ndarray, counts: np.ndarray, n_texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """First arrival times, (n_texts, registers); infinite throughout where a text has no shingle."""
    times = np.full((n_texts, registers), np.inf)
    weight = np.bincount(of, counts, n_texts)
    seeds, text, count, low, length = [], [], [], [], []
    level, members = 0, np.arange(len(keys))
    while len(members):
        # Interval 0 is [0,1); interval k is [2^(k-1), 2^k).
        begin = 0 if level == 0 else 1 << (level - 1)
        seeds.append(tn.mix(keys[members] * np.uint64(0xD1342543DE82EF95) + np.uint64(level)))
        text.append(of[members])
        count.append(counts[members])
        low.append(np.full(len(members), begin))
        length.append(np.full(len(members), max(begin, 1)))
        level += 1
        members = members[counts[members] > (1 << (level - 1))]
    if not seeds:
        return times
    seeds, text, count, low, length = map(np.concatenate, (seeds, text, count, low, length))
    horizon = registers * (np.log(registers) + 4) / np.maximum(weight, 1)
    todo = np.ones(n_texts, bool)
    while True:
        on = np.flatnonzero(todo[text])
        s, t, c, b, n = seeds[on], text[on], count[on], low[on], length[on]
        clock, step = np.zeros(len(on)), 0
        while len(s):
            step += 1
            x = tn.mix(s + np.array([step], np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            clock = clock - np.log(((x >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / n
            live = clock < horizon[t]
            s, t, c, b, n, clock, x = (v[live] for v in (s, t, c, b, n, clock, x))
            y = tn.mix(x ^ np.uint64(0xA0761D6478BD642F))
            # The leading bits of y walk down the halves of the interval.
            coordinate = b + (((y >> np.uint64(40)).astype(np.int64) * n) >> 24)
            hit = coordinate < c
            register = (y[hit] & np.uint64(0xFFFF)).astype(np.int64) * registers >> 16
            np.minimum.at(times.reshape(-1), t[hit] * registers + register, clock[hit])
        todo = np.isinf(times).any(axis=1) & (weight > 0)
        if not todo.any():
            return times
        horizon = horizon * 2


def bands_of(times: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A 64-bit key for each band of each text."""
    raw = times.view(np.uint64).reshape(len(times), bands, -1)
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), raw.shape[:2]).copy()
    for r in range(raw.shape[2]):
        h = tn.mix(h * np.uint64(3) + raw[:, :, r])
    return h.view(np.int64)


def short_registers(times: np.ndarray) -> np.ndarray:
    """16 bits of each register, mixed."""
    return (tn.mix(times.view(np.uint64).copy()) >> np.uint64(48)).astype("<u2")


def sketch(df: DataFrame, key: str, text: str, size: int = SIZE) -> DataFrame:
    """(doc_id, digest, bands, registers): the text's SHA-256, its band keys (null without words) and short registers."""

    def run(batches):
        for batch in batches:
            for part in tn.parts_of(batch, 2):
                data, offsets = tn.utf8(part.column(2))
                of, keys, counts = bags(data, offsets, size)
                times = signatures(of, keys, counts, len(part))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(bands_of(times).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
                empty = pa.array(np.isinf(times[:, 0]))
                lists = pa.compute.if_else(empty, pa.scalar(None, lists.type), lists)
                short = pa.array([r.tobytes() for r in short_registers(times)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, short], ["doc_id", "digest", "bands", "registers"])

    body = F.col(f"`{text}`")
    return df.select(F.col(f"`{key}`").cast("long"), digest_of(body), body).mapInArrow(run, "doc_id long, digest binary, bands array<long>, registers binary")


def promising(pairs: DataFrame, registers: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b) that share a band and agree in enough registers (node, registers) to be at the threshold."""
    n = BANDS * ROWS
    least = int(n * threshold - 6 * (n * threshold * (1 - threshold)) ** 0.5)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, n) for k in (2, 3))
            same = x == y
            banded = same.reshape(-1, BANDS, ROWS).all(2).any(1)
            yield batch.select(["a", "b"]).filter(pa.array(banded & (same.sum(1) >= least)))

    with_b = pairs.join(registers.select(F.col("node").alias("b"), F.col("registers").alias("rb")), "b")
    both = with_b.join(registers.select(F.col("node").alias("a"), F.col("registers").alias("ra")), "a")
    return both.select("a", "b", "ra", "rb").mapInArrow(run, "a long, b long")


def multiset_similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min)/sum(max) of two bags given as sorted distinct keys and counts."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0]
    shared = int(np.minimum(a[1][at[both]], b[1][both]).sum())
    return shared / max(1, int(a[1].sum() + b[1].sum()) - shared)


def full_bags(column: pa.Array, size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The bag of each text, on all 64 bits."""
    data, offsets = tn.utf8(column)
    starts, ends, owner = tn.words(data, offsets)
    h, of = tn.shingles(tn.span_hashes(data, starts, ends), owner, len(column), size)
    cuts = np.searchsorted(of, np.arange(len(column) + 1))
    return [np.unique(h[a:b], return_counts=True) for a, b in zip(cuts[:-1], cuts[1:])]


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def exact_bag(text: str | None, size: int) -> Counter:
    """The bag of a text by its words themselves."""
    words = WORD.findall((text or "").encode())
    if len(words) < size:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[k:] for k in range(size))))


def exactly_alike(a: str | None, b: str | None, size: int, threshold: float) -> bool:
    x, y = exact_bag(a, size), exact_bag(b, size)
    shared = (x & y).total()
    return shared >= threshold * max(1, x.total() + y.total() - shared)


def verified(pairs: DataFrame, texts_of: Callable[[DataFrame], DataFrame], size: int = SIZE, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose multisets overlap by ``threshold``; ``texts_of`` gives (node, text) of nodes.

    Bags of hashed shingles can only overlap more than those of the words, so a pair that fails by
    hashes fails; one that passes is compared by its words.
    """

    def run(batches):
        last = (None, None)
        for batch in batches:
            for part in tn.parts_of(batch, 3):
                a_ids, keep = part.column(0).to_pylist(), []
                bags_b = full_bags(part.column(3), size)
                for k, (i, bag) in enumerate(zip(a_ids, bags_b)):
                    if last[0] != i:
                        last = (i, full_bags(part.column(2).slice(k, 1), size)[0])
                    near = multiset_similarity(last[1], bag) >= threshold
                    keep.append(near and exactly_alike(part.column(2)[k].as_py(), part.column(3)[k].as_py(), size, threshold))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    used = stage(texts_of(wanted), "texts")
    with_b = pairs.join(used.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(used.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def links_of_families(left: DataFrame, texts: DataFrame, size: int = SIZE, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the classes of ``left`` (grp, node, comp) that have any, for groups too large for pairs.

    A link is a pair that shares a group and overlaps by ``threshold``, as it is in small groups; its words
    decide in the end. Groups that share members are a family. A family's nodes are dealt to blocks by a
    hash, and a job compares two blocks by products of their shingle incidence matrices,
    exactly, and tells one link for each pair of classes. So no pair is a row, and a
    job's size is fixed; a node goes to as many jobs as its family has blocks.
    """
    leads = left.groupBy("grp").agg(F.min("node").alias("lead"))
    edges = left.join(leads, "grp").select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    families = stage(components(edges), "families").withColumnRenamed("comp", "fam")
    nodes = left.groupBy("node", "comp").agg(F.collect_set("grp").alias("grps")).join(families, "node")
    blocks = nodes.groupBy("fam").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    placed = nodes.join(blocks, "fam").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(texts, "node")
    jobs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "fam", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "comp", "block", "text", "grps"
    )

    def run(table: pa.Table) -> pa.Table:
        bags = [b for batch in table.combine_chunks().to_batches() for part in tn.parts_of(batch, 6) for b in full_bags(part.column(6), size)]
        node, comp, own = (table.column(c).to_numpy() for c in ("node", "comp", "block"))
        n, sizes = len(bags), np.array([int(c.sum()) for _, c in bags])
        # A shingle that a text holds c times is c elements of a set: (shingle, 0) to (shingle, c - 1).
        rows = np.repeat(np.arange(n), sizes)
        keys = np.concatenate([np.repeat(k, c) for k, c in bags]) if n else np.zeros(0, np.uint64)
        turn = np.concatenate([np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) for _, c in bags]) if n else keys
        _, column, count = np.unique(tn.mix(keys * np.uint64(3) + turn.astype(np.uint64)), return_inverse=True, return_counts=True)
        shared = count[column] > 1
        rows, column = rows[shared], np.unique(column[shared], return_inverse=True)[1]
        inner = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        rows, column = rows[order], column[order]
        for start in range(0, int(column.max(initial=-1)) + 1, 4096):
            a, b = np.searchsorted(column, [start, start + 4096])
            m = np.zeros((n, 4096), np.float32)
            m[rows[a:b], column[a:b] - start] = 1
            inner += m @ m.T
        alike = inner >= threshold * (sizes[:, None] + sizes[None, :] - inner) - 1e-6
        alike &= comp[:, None] < comp[None, :]
        if int(table.column("i")[0].as_py()) != int(table.column("j")[0].as_py()):
            alike &= own[:, None] != own[None, :]
        lists = table.column("grps").combine_chunks()
        member = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        _, group = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        inside = np.zeros((n, int(group.max(initial=-1)) + 1), np.float32)
        inside[member, group] = 1
        alike &= inside @ inside.T > 0
        x, y = np.nonzero(alike)
        seen, links, raw = set(), [], table.column("text")
        for i, j in zip(x.tolist(), y.tolist()):
            pair = (int(comp[i]), int(comp[j]))
            if pair not in seen and exactly_alike(raw[i].as_py(), raw[j].as_py(), size, threshold):
                seen.add(pair)
                links.append((min(node[i], node[j]), max(node[i], node[j])))
        a, b = zip(*links) if links else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return jobs.groupBy("fam", "i", "j").applyInArrow(run, "a long, b long")


def near_dedup(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per row of ``df``: doc_id, class_id, class_size, kept."""
    sketched = stage(sketch(df, key, text, size), "sketches")
    order = F.coalesce("doc_id", F.lit(NULL_ID).cast("long"))
    # One row a text: copies share a node from the start.
    nodes = sketched.groupBy("digest").agg(
        F.min(order).alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"), F.first("registers").alias("registers")
    )
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    registers = nodes.where("bands is not null").select("node", "registers")
    members = nodes.where("bands is not null").select("node", F.explode("bands").alias("grp"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), digest_of(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("least", order).drop("doc_id")

    def texts_of(wanted: DataFrame) -> DataFrame:
        """(node, text) of the wanted nodes, by their smallest documents; unwanted texts aren't moved."""
        named = stage(nodes.select("node", "digest", "least").join(wanted, "node"), "wanted")
        return sift(rows, "digest", named).join(named, ["digest", "least"]).select("node", "text").dropDuplicates(["node"])

    def verify(pairs: DataFrame) -> DataFrame:
        return verified(stage(promising(pairs, registers, threshold), "promising"), texts_of, size, threshold)

    def settle(left: DataFrame) -> DataFrame:
        texts = stage(texts_of(left.select("node").distinct()), "open-texts")
        return links_of_families(left, texts, size, threshold)

    # One round of draws: blocks settle what is left of large groups, so more draws would only be more rows.
    labels = link(members, verify, settle=settle, delegates=(1, 8))
    classes = nodes.select("digest", "least", "node", "n", F.col("bands").isNull().alias("wordless")).join(labels, "node", "left")
    classes = classes.withColumn("comp", F.coalesce("comp", "node"))
    whole = classes.groupBy("comp").agg(F.sum("n").alias("class_size"), F.min(F.struct("least", "digest")).alias("stays"))
    classes = stage(classes.join(whole, "comp").select("digest", "n", "wordless", "class_size", "stays"), "classes")
    alone = F.col("wordless")
    first = F.struct(order.alias("least"), F.col("digest")) == F.col("stays")

    def shown(c):
        return F.when(c != NULL_ID, c)

    told = classes.select("digest", "wordless", "class_size", "stays")
    return even_join(sketched.select("doc_id", "digest"), told, "digest", classes.select("digest", "n"), "inner").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(shown(F.col("stays")["least"])).alias("class_id"),
        F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"),
        (alone | first).alias("kept"),
    )
