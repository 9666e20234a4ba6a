"""Line dedup by a segment-partition edit join.

Two lines are alike if their edit distance in code points is at most 2, and at most
a tenth of the shorter line: 0 below 10 code points, 1 below 20, else 2. Classes are
the connected sets of alike lines. Of each class the first line of the corpus, by
(doc_id, line number), stays and the others go. Lines without a word always stay.

The join: a line allowed t edits is cut into t + 1 segments, of which t edits leave
one whole. A line of length L probes, for each length from L - 2 to L, the places
where a segment of such a line can reappear (shifts limited by the edits before and
after it). Segments and probes are hashed spans of one buffer, so a block's keys
take a dozen array operations; blocks ask (``blocks``) which keys different lines
share, and only lines with such a key become rows. Groups of lines that share a key
go to ``linking``; what it can't settle meets again by two segments of t + 2 and like counts of characters. Pairs are verified by a banded bit-parallel edit distance.

Equal lines are one node from the start, by a keyed 128-bit BLAKE2b of their bytes, so a
line that a third of all documents hold is one row per block until the last step, where
its occurrences are spread (``common.even_join``). The 64-bit spans only find candidates.

At most 2 edits, whatever the length, is a bound of the method: t edits take t + 1
segments and some t^2 probes for each length. So a long line with a word replaced is
another line; what is removed differs by a letter or two from what stays.

Defined results: null text is empty and has no lines; rows of equal id and equal text are
one document, rows of equal or null id and other texts are documents of their own, in the
order of their digests; lines differ by any white space; ties go to the smaller (id, text
digest, line number), null ids first; a line or a text of any length is compared whole; the
two columns of figures replace columns of their names, and every other column stays; an
empty table gives none. A null id is held as the smallest 64-bit number in the order.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import blocks as bl
from pixelloom.llm import textnum as tn
from pixelloom.llm.common import digest_of, discard, even_join, filter_bits, let, stage
from pixelloom.llm.linking import link

MOST_EDITS = 2
PER_EDIT = 10
#: Lines keep more arrays a byte than other operators, so blocks are smaller.
BLOCK_BYTES = 2 << 20


def allowed(length):
    """Edits between lines of which the shorter has so many code points."""
    return np.minimum(MOST_EDITS, np.asarray(length) // PER_EDIT)


class Lines:
    """The lines of texts in a buffer: document, number in it, span; only lines with a word."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        n_docs = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        ends = np.concatenate([breaks, offsets[1:]])
        starts = np.concatenate([breaks + 1, offsets[:-1]])
        # A break ends one line and starts another; a document's borders do one of both.
        starts, ends = np.sort(starts, kind="stable"), np.sort(ends, kind="stable")
        self.doc = np.repeat(np.arange(n_docs), 1 + np.searchsorted(breaks, offsets[1:]) - np.searchsorted(breaks, offsets[:-1]))
        first = np.searchsorted(self.doc, np.arange(n_docs))
        self.number = np.arange(len(self.doc)) - first[self.doc]
        filled = np.concatenate([[0], np.cumsum(~tn.BREAK[data])])
        on = filled[ends] > filled[starts]
        self.doc, self.number, self.start, self.end = self.doc[on], self.number[on], starts[on], ends[on]


def shifts(t: int, gap: int, chosen: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Where untouched segments can reappear in a line longer by ``gap``: the edits before the first, between
    two and after the last move them, and are ``t`` together. A lone segment i has at most i before it and
    t - i after it, or an earlier or a later one is untouched as well."""
    reach = range(-MOST_EDITS, MOST_EDITS + 1)
    if len(chosen) == 1:
        i = chosen[0]
        return [(s,) for s in reach if abs(s) <= i and abs(gap - s) <= t - i]
    return [s for s in product(reach, repeat=len(chosen)) if sum(abs(y - x) for x, y in zip((0, *s), (*s, gap))) <= t]


def segment_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray, chosen: int = 1, probes: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line number, key, whether it is a probe alone) of every ``chosen`` segments and probes of the lines data[start:end].

    A line allowed t edits is cut into t + ``chosen`` segments, of which t edits leave ``chosen`` whole.
    Without ``probes`` only what lines hold themselves is returned.
    """
    heads = np.flatnonzero((data & 0xC0) != 0x80)
    place = np.concatenate([heads, [len(data)]])
    s = np.searchsorted(heads, start)
    size = np.searchsorted(heads, end) - s
    hashed = tn.SpanHasher(data)
    out_line, out_key, out_probe = [], [], []

    lines = np.arange(len(start))
    for gap in range(MOST_EDITS + 1 if probes else 1):
        indexed = size - gap  # the length of the line that holds the segments
        edits = np.where(indexed > 0, allowed(np.maximum(indexed, 0)), 0)
        for t in range(max(gap, 1), MOST_EDITS + 1):
            mine = lines[(edits == t) & (indexed > 0)]
            if not len(mine):
                continue
            n, parts = indexed[mine], t + chosen
            short, long_ones = n // parts, n % parts
            # The last segments are longer by one if the length is no multiple.
            length = [short + (i >= parts - long_ones) for i in range(parts)]
            at = np.cumsum([np.zeros(len(mine), np.int64), *length[:-1]], axis=0)
            for some in combinations(range(parts), chosen):
                tag = n * 8 + t
                for i in some:
                    tag = tag * 8 + i
                for moved in shifts(t, gap, some) if probes else [(0,) * chosen]:
                    ok = np.ones(len(mine), bool)
                    for i, by in zip(some, moved):
                        ok &= (at[i] + by >= 0) & (at[i] + by + length[i] <= size[mine])
                    line = mine[ok]
                    if not len(line):
                        continue
                    key = tag[ok].astype(np.uint64)
                    for i, by in zip(some, moved):
                        p = s[line] + at[i][ok] + by
                        key = tn.mix(hashed(place[p], place[p + length[i][ok]]) * np.uint64(3) + key)
                    out_line.append(line)
                    out_key.append(key)
                    out_probe.append(np.full(len(line), gap > 0 or any(moved)))
    if not out_line:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return np.concatenate(out_line), np.concatenate(out_key), np.concatenate(out_probe)


def distinct_keys(offsets: np.ndarray, data: np.ndarray):
    """Distinct lines of a block's slices and their keys: (start, end, line of each key, key)."""
    starts, ends, lines, keys, base = [], [], [], [], 0
    for a, b in bl.slices(offsets):
        part = data[offsets[a] : offsets[b]]
        found = Lines(offsets[a : b + 1] - offsets[a], part)
        _, at = tn.interned(part, found.start, found.end)
        line, key, _ = segment_keys(part, found.start[at], found.end[at])
        starts.append(found.start[at] + offsets[a])
        ends.append(found.end[at] + offsets[a])
        lines.append(line + base)
        keys.append(key)
        base += len(at)
    if not starts:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64)
    return tuple(map(np.concatenate, (starts, ends, lines, keys)))


def keys_of(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray):
    """A block's distinct keys, each with half the name of its line, or 0 if several lines have it."""
    start, end, line, key = distinct_keys(offsets, data)
    names = tn.digests(data, start, end)[:, 0]
    order = np.argsort(key)
    key, who = key[order], names[line[order]]
    if not len(key):
        return key, who
    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    low, high = np.minimum.reduceat(who, heads), np.maximum.reduceat(who, heads)
    return key[heads], np.where(low == high, low, np.uint64(0))


def merge(n: int, where: np.ndarray, said: np.ndarray) -> np.ndarray:
    """The line that all questions name, or 0."""
    low, high = np.full(n, np.uint64(0xFFFFFFFFFFFFFFFF)), np.zeros(n, np.uint64)
    np.minimum.at(low, where, said)
    np.maximum.at(high, where, said)
    return np.where(low == high, low, np.uint64(0))


def judge(keys: np.ndarray, where: np.ndarray, said: np.ndarray):
    """1 for keys of different lines."""
    return (merge(len(keys), where, said) == 0).astype("u1"), 0, 0


def sharing_lines(blocks: DataFrame) -> DataFrame:
    """(name, text, grps, histogram): lines of blocks with the keys that other lines have too."""

    def run(batches):
        for batch in batches:
            for k, (_, _, offsets, data) in enumerate(bl.opened(batch)):
                start, end, line, key = distinct_keys(offsets, data)
                told = bl.answers_of(batch, k, "u1")
                keys, where = np.unique(key, return_inverse=True)
                assert len(keys) == len(told), "answers don't match the questions"
                on = told[where].astype(bool) if len(keys) else np.zeros(0, bool)
                line, key = line[on], key[on].view(np.int64)
                order = np.argsort(line, kind="stable")
                line, key = line[order], key[order]
                heads = np.flatnonzero(np.r_[True, line[1:] != line[:-1]]) if len(line) else np.zeros(0, np.int64)
                raw, mine = data.tobytes(), line[heads]
                names = tn.digests(data, start[mine], end[mine])
                groups = [np.unique(g) for g in np.split(key, heads[1:])] if len(heads) else []
                texts = [raw[a:b].decode() for a, b in zip(start[mine].tolist(), end[mine].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n.tobytes() for n in names], pa.binary()),
                        pa.array(texts, pa.string()),
                        pa.array(groups, pa.list_(pa.int64())),
                        pa.array([histogram(t) for t in texts], pa.list_(pa.int8())),
                    ],
                    ["name", "text", "grps", "histogram"],
                )

    return blocks.mapInArrow(run, "name binary, text string, grps array<long>, histogram array<tinyint>")


def may_be_alike(x, y):
    """An edit changes a histogram of characters by 2 at most, so alike lines differ by 2 x ``MOST_EDITS``."""
    apart = F.aggregate(F.zip_with(x, y, lambda a, b: F.abs(a.cast("int") - b.cast("int"))), F.lit(0), lambda s, v: s + v)
    return apart <= 2 * MOST_EDITS


def bits_of(keys: DataFrame, bits: int) -> np.ndarray:
    """A filter of 2 ** ``bits`` cells of column ``key``, by its upper bits: at most 8 MB, whatever the input."""
    cell = F.shiftrightunsigned("key", 64 - bits) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bitmap")).collect()
    out = np.zeros((1 << bits - 15, 4096), np.uint8)
    for r in rows:
        out[r["bucket"] - 1] = np.frombuffer(r["bitmap"], np.uint8)
    return out.reshape(-1)


def by_two_segments(now: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) of rows (grp, node, comp, sketch) that are in different classes and share two segments.

    Cut into one segment more, a line has two that the edits leave whole, so no alike pair is lost. What lines
    hold is written; a line's probes, some eleven times as many, become rows if a filter may hold their key.
    """

    def keyed(given: np.ndarray | None, bits: int = 0):
        def run(batches):
            for batch in batches:
                for part in tn.parts_of(batch, 2):
                    data, offsets = tn.utf8(part.column(2))
                    line, key, probe = segment_keys(data, offsets[:-1], offsets[1:], 2, given is not None)
                    if given is not None:
                        cell = (key >> np.uint64(64 - bits)).astype(np.int64)
                        on = given[cell >> 3] >> (cell & 7).astype(np.uint8) & 1 == 1
                        line, key, probe = line[on], key[on], probe[on]
                    line = pa.array(line)
                    columns = [part.column(k).take(line) for k in (0, 1, 3)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(key.view(np.int64)), pa.array(probe)], ["node", "comp", "sketch", "key", "probe"])

        return lines.mapInArrow(run, "node long, comp long, sketch array<tinyint>, key long, probe boolean")

    lines = now.select("node", "comp", "sketch").dropDuplicates(["node"]).join(texts, "node").select("node", "comp", "text", "sketch")
    lines = stage(lines, "open-lines")
    held = stage(keyed(None).drop("probe"), "two-segments")
    bits = filter_bits(held.count())
    asked = keyed(bits_of(held, bits), bits)
    held = held.select("key", F.col("node").alias("other"), F.col("comp").alias("other_comp"), F.col("sketch").alias("seen"))
    # Lines of one length hold the same key unmoved, and meet once.
    once = (F.col("comp") != F.col("other_comp")) & (F.col("probe") | (F.col("node") < F.col("other")))
    return asked.join(held, "key").where(once & may_be_alike(F.col("sketch"), F.col("seen"))).select("node", "other")


def histogram(text: str) -> np.ndarray:
    """How many of its characters fall in each of 32 classes, 127 standing for more; that brings counts no further apart."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.minimum(np.bincount((codes * np.uint32(2654435761)) >> np.uint32(27), minlength=32), 127).astype(np.int8)


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most`` + 1 if it is larger: a band of a few diagonals, a column a step.

    Bit r of column j's words is row j + r - most, so the band slides down with the columns
    and its words keep their width. ``zero`` marks cells that equal their upper left
    neighbour, ``plus`` and ``minus`` vertical steps of +1 and -1.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return most + 1
    # Equal ends don't matter.
    n = len(b)
    head = 0
    while head < n and a[head] == b[head]:
        head += 1
    a, b = a[head:], b[head:]
    n, tail = len(b), 0
    while tail < n and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    if tail:
        a, b = a[:-tail], b[:-tail]
    if not b:
        return min(len(a), most + 1)
    # Rows are b, columns a. The band holds rows j - most .. j + most of column j.
    at: dict[str, int] = {}
    for k, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << (k + most)
    width = 2 * most + 1
    full = (1 << width) - 1
    # Before the first column row i holds i + 1; rows above the matrix take no step.
    plus, minus = full << most & full, 0
    rows = len(b)
    # score: the value on the band's lowest row, then on the matrix's last row.
    score, top = min(most, rows), 1 << (width - 1)
    for j, c in enumerate(a):
        hits = at.get(c, 0) >> j & full
        zero = ((((hits & plus) + plus) ^ plus) | hits | minus) & full
        right_plus = (minus | ~(zero | plus)) & full
        right_minus = zero & plus
        if j + most < rows:
            score += not zero & top
        else:
            last = 1 << (rows - 1 - j + most)
            score += bool(right_plus & last) - bool(right_minus & last)
        shifted = zero >> 1
        plus, minus = (right_minus | ~(shifted | right_plus)) & full, shifted & right_plus
    return min(score, most + 1)


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                most = int(allowed(min(len(x), len(y))))
                keep.append(edit_distance(x, y, most) <= most)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_b = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def occurrences(rows: DataFrame) -> DataFrame:
    """(doc_id, tag, line, name) of every line with a word."""

    def run(batches):
        for batch in batches:
            for part in tn.parts_of(batch, 2):
                data, offsets = tn.utf8(part.column(2))
                found = Lines(offsets, data)
                docs = pa.array(found.doc)
                number, at = tn.interned(data, found.start, found.end)
                names = pa.array([n.tobytes() for n in tn.digests(data, found.start[at], found.end[at])], pa.binary()).take(pa.array(number))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(docs), part.column(1).take(docs), pa.array(found.number.astype(np.int32)), names],
                    ["doc_id", "tag", "line", "name"],
                )

    return rows.select("doc_id", "tag", "text").mapInArrow(run, "doc_id long, tag binary, line int, name binary")


def line_classes(df: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(name, comp) of the lines that have an alike line."""
    blocks = bl.build(df, key, text, block_bytes)
    answers = bl.exchange(blocks, keys_of, judge, merge, "<u8", "u1")
    sharing = stage(sharing_lines(bl.with_answers(blocks, answers)), "sharing-lines")
    # Every block that holds a line says the same of it.
    named = sharing.groupBy("name").agg(F.first("text").alias("text"), F.first("grps").alias("grps"), F.first("histogram").alias("sketch"))
    named = stage(named.withColumn("node", F.monotonically_increasing_id()), "named-lines")
    discard(answers, sharing, blocks)
    members = named.select("node", F.explode("grps").alias("grp"))
    texts = named.select("node", "text")
    labels = link(
        members, lambda pairs: verified(pairs, texts), lambda now: by_two_segments(now, texts), named.select("node", "sketch"), may_be_alike
    )
    return named.select("name", "node").join(labels, "node").select("name", "comp")


def dropped_lines(df: DataFrame, key: str, text: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, tag, n_lines, drops): per document with lines, how many and which go; tag is half the text's digest."""
    bl.bound_batches(df.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), tag_of(body).alias("tag"), body.alias("text"))
    lines = stage(occurrences(rows), "lines")
    classes = stage(line_classes(df, key, text, block_bytes), "classes")
    place = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("doc_id"), "tag", "line")
    firsts = stage(lines.groupBy("name").agg(F.min(place).alias("own"), F.count(F.lit(1)).alias("n")), "firsts")
    joined = firsts.join(classes, "name").select("name", "comp", "own")
    linked = joined.join(joined.groupBy("comp").agg(F.min("own").alias("first")), "comp").select(F.col("name").alias("linked"), "first")
    # Lines that occur once and are like no other stay.
    told = firsts.join(linked, F.col("name") == F.col("linked"), "left").where("n > 1 or first is not null")
    told = stage(told.select("name", F.coalesce("first", "own").alias("first")), "told")
    judged = even_join(lines, told, "name", firsts.select("name", "n"))
    drop = F.coalesce(place != F.col("first"), F.lit(False))
    return judged.groupBy("doc_id", "tag").agg(
        F.countDistinct("line").alias("n_lines"), F.sort_array(F.collect_set(F.when(drop, F.col("line")))).alias("drops")
    )


def tag_of(body):
    """What tells texts of one id apart."""
    return F.substring(digest_of(body), 1, 16)


def without_lines(text, drops):
    """A text without the lines of these numbers, in time that follows its length."""

    def left(lines):
        return F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), drops), lambda k: F.get(lines, k))

    return let(F.split(text, "\n"), lambda lines: F.array_join(left(lines), "\n"))


def line_dedup(
    df: DataFrame, *, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, figures: tuple[str, str] = ("n_lines", "n_dropped")
) -> DataFrame:
    """``df`` with repeated lines taken out of the text, and two columns of ``figures``: lines with a word, lines dropped."""
    drops = stage(dropped_lines(df, key, text, block_bytes), "drops")
    drops = drops.select(F.col("doc_id").alias("id"), F.col("tag").alias("its_tag"), "n_lines", "drops")
    body = F.col(f"`{text}`")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{key}`").cast("long").alias("key"), tag_of(body).alias("tag"))
    joined = rows.join(drops, F.col("key").eqNullSafe(F.col("id")) & (F.col("tag") == F.col("its_tag")), "left")
    body = F.col("row")[text]
    cleaned = F.when(F.size(F.coalesce("drops", F.array().cast("array<int>"))) > 0, without_lines(body, F.col("drops"))).otherwise(body)
    return joined.select(
        *(cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns if c not in figures),
        F.coalesce("n_lines", F.lit(0)).cast("long").alias(figures[0]),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias(figures[1]),
    )
