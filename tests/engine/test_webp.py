from __future__ import annotations

import struct

import numpy as np
import pytest

from pixelloom.sources.codecs import ImageError, webp


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> k & 1 for k in range(n)]

    def code(self, v, n):  # prefix codes go most significant bit first
        self.bits += [v >> k & 1 for k in reversed(range(n))]

    def done(self):
        return np.packbits(self.bits + [0] * (-len(self.bits) % 8), bitorder="little").tobytes()


def lengths_code(w, lengths):
    """Write code lengths in full, with a fixed code of 4 bits for lengths 0..15."""
    w.put(0, 1)
    w.put(15, 4)  # all nineteen
    for k in webp.LENGTH_ORDER:
        w.put(4 if k < 16 else 0, 3)
    w.put(0, 1)
    for n in lengths:
        w.code(n, 4)


def literals(size, bits=8):
    return [bits if k < 256 else 0 for k in range(size)]


def one(w, symbol):
    w.put(1, 1)
    w.put(0, 1)
    w.put(1, 1)
    w.put(symbol, 8)


def body(w, argb, main, cache=0):
    """Literal pixels."""
    w.put(1 if cache else 0, 1)
    if cache:
        w.put(cache, 4)
    if main:
        w.put(0, 1)
    lengths_code(w, literals(280 + (1 << cache if cache else 0)))
    for _ in range(3):
        lengths_code(w, literals(256))
    one(w, 0)
    for p in argb:
        for shift in (8, 16, 0, 24):
            w.code(p >> shift & 255, 8)


def file_of(w):
    raw = b"\x2f" + w.done()
    chunk = b"VP8L" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def start(width, height):
    w = Writer()
    w.put(width - 1, 14)
    w.put(height - 1, 14)
    w.put(1, 1)
    w.put(0, 3)
    return w


def argb_of(rgba):
    v = rgba.astype(np.int64)
    return (v[..., 3] << 24 | v[..., 0] << 16 | v[..., 1] << 8 | v[..., 2]).reshape(-1).tolist()


PX = np.random.default_rng(5).integers(0, 256, (7, 9, 4), dtype=np.uint8)


@pytest.mark.parametrize("cache", [0, 3])
def test_literals(cache):
    w = start(9, 7)
    w.put(0, 1)
    body(w, argb_of(PX), True, cache)
    assert np.array_equal(webp.decode(file_of(w)).rgba, PX)


def test_subtract_green():
    w = start(9, 7)
    w.put(1, 1)
    w.put(2, 2)
    w.put(0, 1)
    less = PX.copy()
    less[..., 0] -= PX[..., 1]
    less[..., 2] -= PX[..., 1]
    body(w, argb_of(less), True)
    assert np.array_equal(webp.decode(file_of(w)).rgba, PX)


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    px = argb_of(PX)
    coded = []
    for at, p in enumerate(px):
        y, x = divmod(at, 9)
        if not at:
            base = webp.BLACK
        elif not y or not x:
            base = px[at - 1] if not y else px[at - 9]
        else:
            base = webp.guess(mode, px[at - 1], px[at - 9], px[at - 10], px[at - 8])
        coded.append(webp.joined((a - b) & 255 for a, b in zip(webp.split(p), webp.split(base))))
    w = start(9, 7)
    w.put(1, 1)
    w.put(0, 2)
    w.put(1, 3)  # tiles of 8
    body(w, [mode << 8] * 2, False)
    w.put(0, 1)
    body(w, coded, True)
    assert np.array_equal(webp.decode(file_of(w)).rgba, PX)


def test_predictions_by_hand():
    g = lambda mode: webp.split(webp.guess(mode, 0x0A141E28, 0x3C46505A, 0x14283C50, 0x64646464))
    assert g(1) == (10, 20, 30, 40) and g(7) == (35, 45, 55, 65) and g(12) == (50, 50, 50, 50)
    assert g(11) == (60, 70, 80, 90) and g(13) == (42, 47, 53, 58) and g(5) == (57, 65, 72, 80)


def test_cross_color():
    w = start(9, 7)
    w.put(1, 1)
    w.put(1, 2)
    w.put(1, 3)
    factors = (25 | (256 - 11) << 8 | 7 << 16)
    body(w, [factors] * 2, False)
    w.put(0, 1)
    v = PX.astype(np.int64)
    green, red = (np.where(c > 127, c - 256, c) for c in (v[..., 1], v[..., 0]))
    less = v.copy()
    less[..., 0] = v[..., 0] - (25 * green >> 5) & 255
    less[..., 2] = v[..., 2] - (-11 * green >> 5) - (7 * red >> 5) & 255
    body(w, argb_of(less), True)
    assert np.array_equal(webp.decode(file_of(w)).rgba, PX)


@pytest.mark.parametrize("n, bits", [(2, 3), (4, 2), (16, 1), (40, 0)])
def test_color_indexing(n, bits):
    table = np.random.default_rng(n).integers(0, 256, (n, 4), dtype=np.uint8)
    idx = np.random.default_rng(n + 1).integers(0, n, (5, 11))
    w = start(11, 5)
    w.put(1, 1)
    w.put(3, 2)
    w.put(n - 1, 8)
    body(w, argb_of(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), False)
    w.put(0, 1)
    each = 8 >> bits
    packed = np.zeros((5, -(-11 >> bits)), np.int64)
    for x in range(11):
        packed[:, x >> bits] |= idx[:, x] << each * (x & (1 << bits) - 1)
    body(w, (packed << 8).reshape(-1).tolist(), True)
    assert np.array_equal(webp.decode(file_of(w)).rgba, table[idx])


def test_copies_and_cache():
    """A literal, a cache reference to it, then a run from the pixel before."""
    w = start(4, 2)
    w.put(0, 1)
    w.put(1, 1)
    w.put(2, 4)
    w.put(0, 1)
    p = 0xFF102030
    slot = (p * webp.HASH & 0xFFFFFFFF) >> 30
    green = [0] * 284
    for symbol in (0x20, 256 + 4, 280 + slot):
        green[symbol] = 2
    lengths_code(w, green)
    one(w, 0x10)
    one(w, 0x30)
    one(w, 0xFF)
    one(w, 1)  # distance code 2: the pixel to the left
    order = sorted((0x20, 260, 280 + slot))
    w.code(order.index(0x20), 2)
    w.code(order.index(280 + slot), 2)
    w.code(order.index(260), 2)
    w.put(1, 1)  # length prefix 4 with one extra bit: 6
    got = webp.decode(file_of(w)).rgba
    assert (got == [0x10, 0x20, 0x30, 255]).all()


@pytest.mark.parametrize("data, text", [
    (b"RIFX", "invalid WebP header"), (b"RIFF\0\0\0\0WEBP", "missing WebP image data"), (b"RIFF\0\0\0\0WEBPVP8 \0\0\0\0", "lossy WebP"),
    (b"RIFF\0\0\0\0WEBPVP8X\1\0\0\0\2\0", "animated WebP"), (b"RIFF\0\0\0\0WEBPVP8L\5\0\0\0\x2e\0\0\0\0", "invalid VP8L signature"),
])
def test_errors(data, text):
    with pytest.raises(ImageError, match=text):
        webp.decode(data)
