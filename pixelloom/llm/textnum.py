"""Texts as numpy arrays: words and word hashes of many texts at once."""

from __future__ import annotations

import ctypes
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

try:
    _LIBC = ctypes.CDLL("libc.so.6")
except OSError:
    _LIBC = None

BREAK = np.zeros(256, bool)
BREAK[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Key of the identities; any other gives the same results.
KEY = b"pixelloom identities"


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def trim() -> None:
    """Return freed memory to the system: Arrow's, which has an allocator of its own, and the C library's."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def free_encoders() -> None:
    """Give back memory before a batch. Workers are reused: a tokenizer's cache that an earlier stage
    left, and freed arrays that the C library keeps, would count against this one."""
    tokens = sys.modules.get("pixelloom.llm.tokens")
    if tokens is not None:
        tokens.release()
    trim()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n+1 offsets of its rows; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def parts_of(batch: pa.RecordBatch, text: int, most_bytes: int = 1 << 20):
    """Slices of a batch with at most ``most_bytes`` of text each, or a single longer row."""
    free_encoders()
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        done = upto[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(upto, done + most_bytes, "right")))
        yield batch.slice(start, end - start)
        start = end
    trim()  # a worker that waits for its next task holds no freed memory


_TABLES: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1), modulo 2**64; one table a base is kept, of 32 MB at most."""
    table = _TABLES.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1 << 16), base, np.uint64)
        table[0] = 1
        np.multiply.accumulate(table, out=table)
        if n <= 1 << 22:
            _TABLES[base] = table
    return table[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of every word ``[^\\x20\\x09-\\x0D]+``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~BREAK[data]
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | opens[1:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | opens[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


class SpanHasher:
    """64-bit hashes of byte spans of one buffer, from one prefix sum over it.

    Overlapping spans cost the same as short ones. It is a polynomial modulo 2**64, so texts can be made
    that collide: it may choose candidates and ranges, and never decides that bytes are equal.
    """

    def __init__(self, data: np.ndarray):
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.multiply(data.astype(np.uint64) + np.uint64(1), powers(BASE, len(data)), out=self.total[1:])
        np.cumsum(self.total, out=self.total)
        self.inverse = powers(BASE_INVERSE, len(data) + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.total[ends] - self.total[starts]) * self.inverse[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def all_of(self, size: int) -> np.ndarray:
        """The hash of every span of ``size`` bytes, by its start."""
        h = (self.total[size:] - self.total[:-size]) * self.inverse[: len(self.total) - size]
        return mix(h + np.uint64(size * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


#: By number of bytes, the mask of a little-endian word that holds them.
LANE = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
LONG = 256


def lanes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int = 0) -> np.ndarray:
    """Bytes ``at`` to ``at`` + 7 of each span as a number; zeros stand beyond its end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    return words[np.minimum(starts + at, len(data))] & LANE[np.clip(ends - starts - at, 0, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, eight bytes a step through a bijection; no structure in texts makes it collide."""
    import xxhash

    size = ends - starts
    h = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ np.uint64(0x2545F4914F6CDD1D))
    short = np.flatnonzero(size <= LONG)
    at = 0
    while len(short):
        h[short] = mix((h[short] ^ lanes(data, starts[short], ends[short], at)) * np.uint64(0x9FB21C651E98DF25))
        at += 8
        short = short[size[short] > at]
    for k in np.flatnonzero(size > LONG).tolist():
        h[k] = xxhash.xxh3_64_intdigest(data[starts[k] : ends[k]].tobytes(), 0x51ED270B)
    return h


def interned(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans by their bytes: (number of each span's text, a span of each number). Equal numbers are equal bytes.

    Up to 16 bytes a span is two lanes and its length; a longer one has its place in a dictionary for lanes.
    """
    size = ends - starts
    low, high = lanes(data, starts, ends), lanes(data, starts, ends, 8)
    seen: dict[bytes, int] = {}
    far = np.flatnonzero(size > 16)
    if len(far):
        low[far] = [seen.setdefault(data[a:b].tobytes(), len(seen)) for a, b in zip(starts[far].tolist(), ends[far].tolist())]
        high[far] = 0
    h = mix(low ^ mix(high + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    same = (low[first][number] == low) & (high[first][number] == high) & (size[first][number] == size)
    if not same.all():
        _, first, number = np.unique(np.stack([low, high, size.astype(np.uint64)], 1), axis=0, return_index=True, return_inverse=True)
    return number.reshape(-1), first


def digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed 128-bit BLAKE2b of each span, as an (n, 2) array of 64-bit numbers: an identity across blocks."""
    from hashlib import blake2b

    raw = data.tobytes()
    found = b"".join([blake2b(raw[a:b], digest_size=16, key=KEY).digest() for a, b in zip(starts.tolist(), ends.tolist())])
    return np.frombuffer(found, "<u8").reshape(-1, 2)


def shingles(hashes: np.ndarray, owner: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text number) of every run of ``size`` words, by text; a shorter text with words has one, of all its words."""
    counts = np.bincount(owner, minlength=n_texts) if len(owner) else np.zeros(n_texts, np.int64)
    firsts = np.cumsum(counts) - counts
    if len(hashes) >= size:
        h = np.zeros(len(hashes) - size + 1, np.uint64)
        for j in range(size):
            h = mix(h * np.uint64(3) + hashes[j : len(h) + j])
        whole = owner[: len(h)] == owner[size - 1 :]
        h, of = h[whole], owner[: len(whole)][whole]
    else:
        h, of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        extra = []
        for d in short.tolist():
            x = np.uint64(counts[d])
            x = np.array([x])
            for k in range(firsts[d], firsts[d] + counts[d]):
                x = mix(x * np.uint64(3) + hashes[k])
            extra.append(x)
        h, of = np.concatenate([h, *extra]), np.concatenate([of, short])
        order = np.argsort(of, kind="stable")
        h, of = h[order], of[order]
    return h, of
