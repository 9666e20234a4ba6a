"""Suffix-array dedup: bytes of repeated 50-byte strings, by bucket-pointer refinement around shared anchors.

A byte goes if a 50-byte string over it also starts in a document with a smaller id.

1. Equal documents, by SHA-256: of 50 bytes or more, all but the smallest id go whole.
2. *Anchors.* Of each run of 21 successive 30-grams the one with the smallest hash
   is an anchor, so each 50-byte string holds one, at a place its own bytes decide.
   Blocks ask (``blocks``) which anchors several documents have, and how many places.
3. A 50-byte string belongs to its anchor. If that is shared, its key range gets the bytes around the anchor: a context.
4. There the suffixes of an anchor's unlike contexts are sorted to 50 bytes by bucket-pointer refinement. Suffixes
   go into buckets by their first 8 bytes, and a suffix points at its bucket's first place in the
   order. Contexts equal to a smaller document's have gone before. Buckets are refined by sorting on the pointers of the suffixes 8 bytes later, which makes
   16 sorted bytes; then, with the pointers updated, 16 bytes later, and 18 bytes after that, which
   makes 50. Only buckets with company are sorted again. Each bucket is now one string, and the
   smallest document in it stays.
5. Answers return to the blocks, which cut the bytes.

A block sends each distinct context once, for its smallest document, and settles
its other documents itself, so a passage that a third of all documents hold costs a
row per block. At a passage's ends contexts differ in every document though. An anchor
with more than ``HOT`` places sends its strings one by one, each to the range of its own
hash, where equal strings are found by sorting them whole; so no anchor gathers in a task.

Hashes choose anchors and ranges, and a string is compared by its bytes. (Anchors of
equal 64-bit hash whose bytes differ are told apart, since the 30 bytes are part of the context.)

Defined results: null text is empty, and has 0 bytes and the hash of nothing; texts
under 50 bytes stay whole; rows of equal id are one document, whose own repeats
don't count; of ties nothing depends on the order of rows; a text of any length is read
whole; other columns, whatever their names, are not read; an empty table gives none. A
null id is held as the smallest 64-bit number, so a row with that id counts as one without.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelloom.llm import blocks as bl
from pixelloom.llm import textnum as tn
from pixelloom.llm.common import digest_of, even_join, filter_bits, filter_of, in_filter, sift, stage

LENGTH, GRAM = 50, 30
SPAN = LENGTH - GRAM + 1  # successive grams of a string; also the places an anchor may have in it
SIDE = LENGTH - GRAM  # bytes a string may have on either side of its anchor
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Places of an anchor beyond which its strings are dealt one by one.
HOT = 2000
#: Bytes of a block whose anchors are looked for at once: arrays of some 1 MB, which caches hold.
SLICE = 1 << 17
#: Contexts that are refined at once, unless an anchor has more.
TOGETHER = 20_000


def sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """``op`` over each window of ``size`` values (minimum or maximum), by doubling."""
    done, have = x, 1
    while have * 2 <= size:
        done = op(done[:-have], done[have:])
        have *= 2
    return op(done[: len(done) - (size - have)], done[size - have :]) if have < size else done


def strings_of(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the texts: (anchor places, their hashes, for each 50-byte string's place the number of its
    anchor or -1). Of equal hashes in a string the first counts."""
    n = len(data)
    of_string = np.full(n, -1, np.int32)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), of_string
    h = tn.SpanHasher(data).all_of(GRAM)
    low = sliding(h, SPAN, np.minimum)  # per string place
    real = np.ones(len(low), bool)
    # Strings that would cross a text's end aren't strings.
    for e in offsets[1:-1].tolist():
        real[max(0, e - LENGTH + 1) : e] = False
    low = np.where(real, low, TOP)
    # A gram is an anchor if it is the least of some string around it.
    wide = np.full(len(h) + SPAN - 1, np.uint64(0))
    shown = np.where(real, low, np.uint64(0))
    wide[SPAN - 1 : SPAN - 1 + len(shown)] = shown
    anchors = np.flatnonzero(sliding(wide, SPAN, np.maximum)[: len(h)] == h)
    if not len(anchors):
        return anchors, h[anchors], of_string
    # The first gram with the least hash. It stays the same until the least hash changes or the
    # string's start passes it, so it is looked for where that happens: walk anchors from there.
    passed = np.zeros(len(low), bool)
    passed[anchors[anchors < len(low) - 1] + 1] = True
    passed[1:] |= (low[1:] != low[:-1]) | (real[1:] != real[:-1])
    passed[0] = True
    heads = np.flatnonzero(passed)
    least = low[heads]
    k = np.minimum(np.searchsorted(anchors, heads), len(anchors) - 1)
    todo = np.flatnonzero(real[heads])
    while len(todo):
        todo = todo[h[anchors[k[todo]]] != least[todo]]
        k[todo] += 1
    of_string[: len(low)] = np.repeat(np.where(real[heads], k, -1), np.diff(np.r_[heads, len(low)]))
    return anchors, h[anchors], of_string


def block_strings(offsets: np.ndarray, data: np.ndarray):
    """``strings_of`` for a whole block, in slices that bound memory: places are the block's."""
    places, hashes, owners, base = [], [], [], 0
    for a, b in bl.slices(offsets, SLICE):
        p, h, o = strings_of(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
        places.append(p + offsets[a])
        hashes.append(h)
        o[o >= 0] += base
        owners.append(o)
        base += len(p)
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32)
    return np.concatenate(places), np.concatenate(hashes), np.concatenate(owners)


def keys_of(ids: np.ndarray, offsets: np.ndarray, data: np.ndarray):
    """A block's distinct anchors: twice their number of places, and 1 more if several of its documents have one."""
    places, hashes, _ = block_strings(offsets, data)
    doc = np.searchsorted(offsets, places, "right") - 1
    order = np.argsort(hashes, kind="stable")  # places ascend, and documents with them
    hashes, doc = hashes[order], doc[order]
    heads = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.zeros(0, np.int64)
    tails = np.r_[heads[1:], len(hashes)] - 1
    return hashes[heads], 2 * (tails - heads + 1) + (doc[heads] != doc[tails]) if len(heads) else np.zeros(0, np.int64)


def merge(n: int, where: np.ndarray, said: np.ndarray) -> np.ndarray:
    """What several blocks say together: all places, and whether several documents have them."""
    places = np.bincount(where, said >> 1, n).astype(np.int64)
    several = (np.bincount(where, minlength=n) > 1) | (np.bincount(where, said & 1, n) > 0)
    return 2 * np.minimum(places, (1 << 31) - 1) + several


def judge(keys: np.ndarray, where: np.ndarray, said: np.ndarray):
    """0 for an anchor of one document, 1 for a shared one, 2 for one whose strings go one by one."""
    together = merge(len(keys), where, said.astype(np.int64))
    return ((together & 1) * (1 + (together >> 1 > HOT))).astype("u1"), 0, 0


def anchored(offsets: np.ndarray, data: np.ndarray, told: np.ndarray):
    """``block_strings`` and, for each anchor place, the answer ``told`` of its key."""
    places, hashes, owner = block_strings(offsets, data)
    keys, where = np.unique(hashes, return_inverse=True)
    if len(keys) != len(told):
        raise AssertionError("answers don't match the questions")
    return places, hashes, owner, told[where] if len(keys) else np.zeros(0, "u1")


def leads(anchor: np.ndarray, doc: np.ndarray, most: np.ndarray, least: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Per context one with equal anchor, bounds and bytes and the smallest document, or itself. Hashes only bring equal ones together."""
    n = len(anchor)
    lead = np.arange(n)
    if not n:
        return lead
    packed = np.ascontiguousarray(np.concatenate([around, most[:, None].astype(np.uint8), least[:, None].astype(np.uint8)], 1))
    width = packed.shape[1]
    rows = packed.view(np.dtype((np.void, width))).reshape(-1)
    finger = tn.span_hashes(packed.reshape(-1), np.arange(n) * width, np.arange(1, n + 1) * width)
    order = np.lexsort((doc, finger, anchor))
    sure = (finger[order][1:] == finger[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])
    sure[sure] = rows[order[1:][sure]] == rows[order[:-1][sure]]
    heads = np.flatnonzero(np.r_[True, ~sure])
    lead[order] = order[heads][np.cumsum(np.r_[0, ~sure])]
    return lead


def whole_masks(most: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Masks of all strings of contexts: bits ``least`` to ``most``."""
    one = np.uint64(1)
    return ((one << (most.astype(np.uint64) + one)) - (one << least.astype(np.uint64))).astype(np.uint32)


class Contexts:
    """The shared strings of a block, by anchor: what to send, and how answers come back.

    ``low`` and ``high`` bound, per context, the places of an anchor's strings, counted
    as bytes before the anchor; ``lead`` is the context of a smaller document of the
    block with the same bytes, or itself.
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, found: tuple):
        places, hashes, owner, told = found
        common = told == 1
        strings = np.flatnonzero(np.append(common, False)[owner])  # -1 is the last one
        mine = owner[strings]
        heads = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]]) if len(mine) else np.zeros(0, np.int64)
        self.anchor = places[mine[heads]]
        self.hash = hashes[mine[heads]]
        first = strings[heads]
        last = strings[np.r_[heads[1:], len(strings)] - 1] if len(heads) else first
        self.most, self.least = self.anchor - first, self.anchor - last
        doc = np.searchsorted(offsets, self.anchor, "right") - 1
        self.doc = ids[doc]
        # Bytes from the first string's start to the last one's end, at fixed places around the anchor.
        padded = np.concatenate([np.zeros(SIDE, np.uint8), data, np.zeros(LENGTH, np.uint8)])
        self.bytes = np.zeros((len(self.anchor), 2 * SIDE + GRAM), np.uint8)
        for k in range(0, len(self.anchor), 10_000):
            span = self.anchor[k : k + 10_000, None] + np.arange(2 * SIDE + GRAM)[None, :]
            self.bytes[k : k + 10_000] = padded[span]
        column = np.arange(2 * SIDE + GRAM)[None, :]
        outside = (column < (SIDE - self.most)[:, None]) | (column >= (SIDE - self.least + LENGTH)[:, None])
        self.bytes[outside] = 0
        # One context for equal (anchor, bounds, bytes) of a block: its smallest document's.
        self.lead = leads(self.hash, self.doc, self.most, self.least, self.bytes)
        self.sent = np.flatnonzero(self.lead == np.arange(len(self.lead)))
        self.sent = self.sent[np.argsort(self.hash[self.sent], kind="stable")]


class Strings:
    """The strings of a block's hot anchors, one by one.

    Equal strings have their anchor at the same place, so they are looked for offset by offset.
    ``start`` is a string's place, ``lead`` the equal string of a smaller document of the block, or itself.
    """

    def __init__(self, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, found: tuple):
        self.data = data
        places, hashes, owner, told = found
        hot = told == 2
        if not hot.any():
            self.start = self.doc = self.sent = self.lead = np.zeros(0, np.int64)
            self.hash = np.zeros(0, np.uint64)
            return
        self.start = np.flatnonzero(np.append(hot, False)[owner])
        self.hash = np.zeros(len(self.start), np.uint64)
        self.lead = np.arange(len(self.start))
        if not len(self.start):
            self.doc = self.sent = np.zeros(0, np.int64)
            return
        self.doc = ids[np.searchsorted(offsets, self.start, "right") - 1]
        self.hash = tn.span_hashes(data, self.start, self.start + LENGTH)
        before = places[owner[self.start]] - self.start
        for a in range(SPAN):
            mine = np.flatnonzero(before == a)
            mine = mine[np.lexsort((self.doc[mine], self.hash[mine]))]
            if len(mine) < 2:
                continue
            text = self.texts(mine)
            same = (self.hash[mine][1:] == self.hash[mine][:-1]) & (text[1:] == text[:-1])
            heads = np.flatnonzero(np.r_[True, ~same])
            self.lead[mine] = mine[heads][np.cumsum(np.r_[0, ~same])]
        self.sent = np.flatnonzero(self.lead == np.arange(len(self.start)))
        self.sent = self.sent[np.argsort(self.hash[self.sent], kind="stable")]

    def texts(self, which: np.ndarray) -> np.ndarray:
        rows = self.data[self.start[which][:, None] + np.arange(LENGTH)[None, :]]
        return np.ascontiguousarray(rows).view(f"V{LENGTH}").reshape(-1)


def refine(pointer: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pointers of suffixes sorted by (pointer, key), both numbers of places: members of a bucket with
    company point at their part's first place. Other buckets aren't touched."""
    members = np.flatnonzero(np.bincount(pointer)[pointer] > 1)
    if not len(members):
        return pointer
    both = pointer[members] * np.int64(len(pointer) + int(key.max()) + 1) + key[members]
    order = np.argsort(both)
    members, both = members[order], both[order]
    place = pointer[members]
    heads = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    first = np.repeat(heads, np.diff(np.r_[heads, len(members)]))
    finer = np.r_[True, both[1:] != both[:-1]]
    out = pointer.copy()
    out[members] = place + np.flatnonzero(finer)[np.cumsum(finer) - 1] - first
    return out


def by_grams(grams: np.ndarray) -> np.ndarray:
    """The first buckets: pointers of suffixes sorted by their leading bytes."""
    order = np.argsort(grams)
    ranked = grams[order]
    heads = np.r_[True, ranked[1:] != ranked[:-1]]
    out = np.empty(len(grams), np.int64)
    out[order] = np.flatnonzero(heads)[np.cumsum(heads) - 1]
    return out


def suffix_buckets(texts: np.ndarray, steps: tuple[int, ...] = (8, 16, 18)) -> np.ndarray:
    """The bucket of every suffix of rows of bytes, to a depth of 8 + sum(steps), in suffix order.

    ``pointer`` is a suffix's bucket. Each step sorts buckets by the pointers of the suffixes so many
    bytes later, as the step before left them; a step is at most the depth that is sorted already.
    """
    n, width = texts.shape
    wide = width - 7
    grams = np.zeros((n, wide), np.uint64)
    for k in range(8):
        grams = grams << np.uint64(8) | texts[:, k : k + wide].astype(np.uint64)
    pointer = by_grams(grams.reshape(-1))
    for step in steps:
        pointer = pointer.reshape(n, wide)
        wide -= step
        here, later = pointer[:, :wide].reshape(-1), pointer[:, step:].reshape(-1)
        pointer = refine(compact(here), later)
    return pointer.reshape(n, wide)


def compact(pointer: np.ndarray) -> np.ndarray:
    """Pointers among fewer suffixes: the first places of the buckets that are left."""
    counts = np.bincount(pointer)
    return (np.cumsum(counts) - counts)[pointer]


def repeated(doc: np.ndarray, most: np.ndarray, least: np.ndarray, around: np.ndarray) -> np.ndarray:
    """Per context the mask of its strings that a smaller document has too: bit a is the string with a bytes before the anchor."""
    masks = np.zeros(len(doc), np.uint32)
    if not len(doc):
        return masks
    bucket = suffix_buckets(around)
    for a in range(SPAN):
        have = np.flatnonzero((least <= a) & (a <= most))
        key = bucket[have, SIDE - a]
        smallest = np.full(bucket.size, np.iinfo(np.int64).max)
        np.minimum.at(smallest, key, doc[have])
        masks[have[doc[have] > smallest[key]]] |= np.uint32(1 << a)
    return masks


SENT = "range int, block long, hot boolean, anchor binary, doc binary, most binary, least binary, around binary"
NONE = np.zeros(0, np.uint8)


def send_contexts(blocks: DataFrame, bits: int) -> DataFrame:
    """Rows of ``SENT``: contexts of shared anchors by anchor, and strings of hot ones, in ``around``, by their hash."""

    def run(batches):
        kinds = [pa.int32(), pa.int64(), pa.bool_(), *[pa.binary()] * 5]
        names = ["range", "block", "hot", "anchor", "doc", "most", "least", "around"]
        for batch in batches:
            for k, (block, ids, offsets, data) in enumerate(bl.opened(batch)):
                found = anchored(offsets, data, bl.answers_of(batch, k, "u1"))
                c = Contexts(ids, offsets, data, found)
                rows = []
                for r, a, b in bl.cuts(c.hash[c.sent], bits):
                    w = c.sent[a:b]
                    rows.append((r, block, False, c.hash[w].tobytes(), c.doc[w].tobytes(), c.most[w].astype("u1").tobytes(), c.least[w].astype("u1").tobytes(), c.bytes[w].tobytes()))
                c = Strings(ids, offsets, data, found)
                for r, a, b in bl.cuts(c.hash[c.sent], bits):
                    w = c.sent[a:b]
                    rows.append((r, block, True, b"", c.doc[w].tobytes(), b"", b"", c.texts(w).tobytes()))
                for start in range(0, len(rows), 1000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[start : start + 1000]), kinds)], names)

    return blocks.mapInArrow(run, SENT)


def settle(contexts: DataFrame) -> DataFrame:
    """(block, range, hot, answer): per context sent, the mask of its repeated strings; per hot string, 1 if it is repeated."""

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        table = table.combine_chunks()
        hot = table.column("hot").to_numpy()
        press = zstandard.ZstdCompressor(level=3)
        answers: list[bytes] = [b""] * table.num_rows

        def column(rows, name, kind):
            found = [np.frombuffer(table.column(name)[k].as_buffer(), kind) for k in rows]
            return np.concatenate(found) if found else np.zeros(0, kind)

        def say(rows, values, width):
            end = 0
            for k in rows:
                start, end = end, end + len(table.column("doc")[k].as_buffer()) // 8
                answers[k] = press.compress(values[start:end].astype(width).tobytes())

        rows = np.flatnonzero(~hot).tolist()
        anchor, doc = column(rows, "anchor", np.uint64), column(rows, "doc", np.int64)
        most, least = column(rows, "most", np.uint8), column(rows, "least", np.uint8)
        around = column(rows, "around", np.uint8).reshape(-1, 2 * SIDE + GRAM)
        masks = np.zeros(len(anchor), np.uint32)
        # Blocks that hold one passage send one context; only anchors with several are refined,
        # in bounded parts that never cut an anchor's contexts apart.
        lead = leads(anchor, doc, most, least, around)
        ones = np.flatnonzero(lead == np.arange(len(lead)))
        ones = ones[np.argsort(anchor[ones], kind="stable")]
        edges = np.flatnonzero(np.r_[True, anchor[ones][1:] != anchor[ones][:-1], True]) if len(ones) else np.zeros(1, np.int64)
        company = np.repeat(np.diff(edges) > 1, np.diff(edges))
        ones = ones[company]
        edges = np.flatnonzero(np.r_[True, anchor[ones][1:] != anchor[ones][:-1], True]) if len(ones) else np.zeros(1, np.int64)
        start = 0
        while start < len(edges) - 1:
            end = max(start + 1, int(np.searchsorted(edges, edges[start] + TOGETHER, "right")) - 1)
            part = ones[edges[start] : edges[end]]
            masks[part] = repeated(doc[part], most[part].astype(np.int64), least[part].astype(np.int64), around[part])
            start = end
        masks = masks[lead]
        later = doc > doc[lead]
        masks[later] |= whole_masks(most[later], least[later])
        say(rows, masks, "<u4")
        rows = np.flatnonzero(hot).tolist()
        doc = column(rows, "doc", np.int64)
        texts = column(rows, "around", np.uint8).reshape(-1, LENGTH)
        bucket = suffix_buckets(texts)[:, 0] if len(texts) else np.zeros(0, np.int64)
        smallest = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(smallest, bucket, doc)
        say(rows, doc > smallest[bucket], "u1")
        return pa.table({"block": table.column("block"), "range": table.column("range"), "hot": table.column("hot"), "answer": pa.array(answers, pa.binary())})

    return contexts.groupBy("range").applyInArrow(run, "block long, range int, hot boolean, answer binary")


#: ``kept`` are the bytes that stay (a cut may split a character, so they aren't a string), ``removed`` the
#: byte ranges that go, ascending, as [start, end).
RESULT = "doc_id long, n_bytes long, kept binary, removed array<struct<start: long, end: long>>"


def cut(blocks: DataFrame) -> DataFrame:
    """Blocks with both answers to rows of ``RESULT``."""
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(span)]

    def run(batches):
        for batch in batches:
            settled, hot = (pa.RecordBatch.from_arrays([batch.column(n)], ["answers"]) for n in ("settled", "hot"))
            for k, (_, ids, offsets, data) in enumerate(bl.opened(batch)):
                found = anchored(offsets, data, bl.answers_of(batch, k, "u1"))
                c = Contexts(ids, offsets, data, found)
                told = bl.answers_of(settled, k, "<u4")
                masks = np.zeros(len(c.anchor), np.uint32)
                masks[c.sent] = told
                follow = c.lead != np.arange(len(c.lead))
                masks = masks[c.lead]
                # Strings of a context that follows a smaller document's are repeated, all of them.
                later = follow & (c.doc > c.doc[c.lead])
                masks[later] |= whole_masks(c.most[later], c.least[later])
                gone = np.zeros(len(data) + 1, np.int32)
                for a in range(SPAN):
                    s = c.anchor[(masks >> np.uint32(a)) & np.uint32(1) == 1] - a
                    np.add.at(gone, s, 1)
                    np.add.at(gone, s + LENGTH, -1)
                one = Strings(ids, offsets, data, found)
                flags = np.zeros(len(one.start), bool)
                flags[one.sent] = bl.answers_of(hot, k, "u1").astype(bool)
                flags = flags[one.lead] | (one.doc > one.doc[one.lead])
                np.add.at(gone, one.start[flags], 1)
                np.add.at(gone, one.start[flags] + LENGTH, -1)
                gone = np.cumsum(gone[:-1], dtype=np.int32) > 0
                # A span ends where the next byte stays or is another document's.
                opens, shuts = gone.copy(), gone.copy()
                border = np.zeros(len(data) + 1, bool)
                border[offsets] = True
                opens[1:] &= ~gone[:-1] | border[1:-1]
                shuts[:-1] &= ~gone[1:] | border[1:-1]
                starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
                first = np.searchsorted(starts, offsets)
                base = np.repeat(offsets[:-1], np.diff(first))
                spans = pa.StructArray.from_arrays([pa.array(starts - base, pa.int64()), pa.array(ends - base, pa.int64())], fields=list(span))
                stays = ~gone
                upto = np.r_[0, np.cumsum(stays)][offsets]
                for a, b in bl.slices(offsets):
                    lists = pa.array(first[a : b + 1] - first[a], pa.int32())
                    left = data[offsets[a] : offsets[b]][stays[offsets[a] : offsets[b]]].tobytes()
                    at = (upto[a : b + 1] - upto[a]).tolist()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([None if i == -(1 << 63) else i for i in ids[a:b].tolist()], kinds[0]),
                            pa.array(np.diff(offsets[a : b + 1]), kinds[1]),
                            pa.array([left[x:y] for x, y in zip(at, at[1:])], kinds[2]),
                            pa.ListArray.from_arrays(lists, spans.slice(first[a], first[b] - first[a])),
                        ],
                        ["doc_id", "n_bytes", "kept", "removed"],
                    )

    return blocks.mapInArrow(run, RESULT)


def digested(done: DataFrame) -> DataFrame:
    """``done`` with the figures of its kept bytes and removed ranges."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return done.select("*", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def repeated_substrings(df: DataFrame, *, key: str = "doc_id", text: str = "text", block_bytes: int = 2 << 20) -> DataFrame:
    """One row per row of ``df``: doc_id, n_bytes, kept, removed (``RESULT``), and of these n_removed, n_spans, kept_sha256."""
    rows = df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        digest_of(F.col(f"`{text}`")).alias("digest"),
    )
    digests = stage(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("size")), "digests")
    order = F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long"))
    groups = digests.where(F.col("size") >= LENGTH).groupBy("digest").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))
    groups = stage(groups.where("first < last"), "copied")
    # A row is a copy by its text, so ids shared by unlike rows stay apart. Texts that have no copy
    # pass by a filter of at most 8 MB; the others meet their group, a popular one's spread.
    bits = filter_bits(groups.count())
    marked = in_filter(rows, "digest", stage(filter_of(groups, "digest", bits), "filter"), bits)
    maybe = marked.where("__in").drop("__in").select("doc_id", "text", "digest", order.alias("order"))
    met = even_join(maybe, groups.select("digest", "first"), "digest", groups.select("digest", "n")).where(F.col("first").isNull() | (F.col("order") <= F.col("first")))
    fresh = marked.where("not __in").select("doc_id", "text").unionByName(met.select("doc_id", "text"))
    copies = even_join(sift(digests, "digest", groups), groups.select("digest", "first"), "digest", groups.select("digest", "n"), "inner").where(order > F.col("first"))
    gone = copies.select(
        "doc_id",
        F.col("size").alias("n_bytes"),
        F.unhex(F.lit("")).alias("kept"),
        F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))).alias("removed"),
    )
    blocks = bl.build(fresh, "doc_id", "text", block_bytes)
    # Contexts are ten times as large as keys.
    shared = bl.exchange(blocks, keys_of, judge, merge, "<u4", "u1", 1)
    known = bl.with_answers(blocks, shared)
    settled = stage(settle(send_contexts(known, bl.range_bits(blocks) + 1)), "settled")

    def told(hot: str, name: str) -> DataFrame:
        lists = settled.where(hot).groupBy("block").agg(F.sort_array(F.collect_list(F.struct("range", "answer"))).alias("l"))
        return lists.select("block", F.transform("l", lambda x: x["answer"]).alias(name))

    both = known.join(told("not hot", "settled"), "block", "left").join(told("hot", "hot"), "block", "left")
    return digested(cut(both).unionByName(gone))
