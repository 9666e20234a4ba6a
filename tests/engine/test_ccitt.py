from __future__ import annotations

import numpy as np
import pytest

from pixelloom.sources.codecs import ImageError, ccitt, tiff
from tests.engine.test_jpeg import ifd

WORDS = [{n: w for w, n in t.items()} for t in ccitt.RUNS]
MODE = {v: k for k, v in ccitt.MODES.items()}


def changes_of(row):
    return np.flatnonzero(np.diff(np.r_[0, row, row[-1] ^ 1])).tolist()


def run(n, color):
    out = ""
    while n >= 64:
        part = min(2560, n // 64 * 64)
        out, n = out + WORDS[color][part], n - part
    return out + WORDS[color][n]


def flat(row):
    marks = [0, *changes_of(row)]
    return "".join(run(b - a, k % 2) for k, (a, b) in enumerate(zip(marks, marks[1:])))


def relative(row, above):
    """The standard's coding procedure."""
    w, out, a0, color = len(row), "", -1, 0
    pixel = lambda r, x: 0 if x < 0 else int(r[x])

    def change(r, x, c):  # the first change right of x, to the colour other than c
        for k in range(max(x + 1, 0), w):
            if pixel(r, k) != pixel(r, k - 1) and pixel(r, k) != c:
                return k
        return w

    def any_change(r, x):
        return next((k for k in range(x + 1, w) if pixel(r, k) != pixel(r, k - 1)), w)

    while a0 < w:
        a1 = next((k for k in range(max(a0, 0), w) if pixel(row, k) != color), w)
        b1 = change(above, a0, color)
        b2 = any_change(above, b1) if b1 < w else w
        if b2 < a1:
            out, a0 = out + MODE["pass"], b2
        elif abs(a1 - b1) <= 3:
            out, a0, color = out + MODE[a1 - b1], a1, color ^ 1
        else:
            a2 = next((k for k in range(a1, w) if pixel(row, k) == color), w)
            out += MODE["horizontal"] + run(a1 - max(a0, 0), color) + run(a2 - a1, color ^ 1)
            a0 = a2
    return out


def packed(text):
    return np.packbits(np.frombuffer((text + "0" * (-len(text) % 8)).encode(), np.uint8) - 48).tobytes()


def drawing(w, h=20):
    rng = np.random.default_rng(w)
    px = np.zeros((h, w), np.uint8)
    for _ in range(12):
        x, y = rng.integers(0, w), rng.integers(0, h)
        px[y : y + rng.integers(1, 8), x : x + rng.integers(1, max(2, w // 2))] ^= 1
    px[3] = rng.integers(0, 2, w)
    px[5] = 1
    return px


@pytest.mark.parametrize("w", [1, 8, 37, 200, 3000])
def test_all_ways(w):
    px = drawing(w)
    want = np.packbits(px, axis=1).tobytes()
    blank = np.zeros(w, np.uint8)
    rows = b"".join(packed(flat(r)) for r in px)
    assert ccitt.decode(rows, w, 20, ccitt.ROWS) == want
    eol = "000000000001"
    assert ccitt.decode(packed("".join(map(flat, px))), w, 20, ccitt.GROUP3) == want
    assert ccitt.decode(packed("".join("0000" + eol + flat(r) for r in px)), w, 20, ccitt.GROUP3) == want
    both = "".join(eol + ("1" + flat(r) if k % 4 == 0 else "0" + relative(r, px[k - 1])) for k, r in enumerate(px))
    assert ccitt.decode(packed(both), w, 20, ccitt.GROUP3, 1) == want
    four = packed("".join(relative(r, px[k - 1] if k else blank) for k, r in enumerate(px)))
    assert ccitt.decode(four, w, 20, ccitt.GROUP4) == want
    mirrored = np.packbits(np.unpackbits(np.frombuffer(four, np.uint8), bitorder="little")).tobytes()
    assert ccitt.decode(mirrored, w, 20, ccitt.GROUP4, fill_order=2) == want
    entries = [(256, 4, 1, w), (257, 4, 1, 20), (258, 3, 1, 1), (259, 3, 1, 4), (262, 3, 1, 0), (273, 4, 1, "s"), (277, 3, 1, 1), (279, 4, 1, len(four))]
    assert np.array_equal(tiff.decode(ifd(entries, {"s": four})).rgba[..., 0], np.where(px, 0, 255))


def test_errors():
    with pytest.raises(ImageError, match="CCITT"):
        ccitt.decode(b"\0\0\0", 100, 2, ccitt.GROUP4)
    assert len(WORDS[0]) == len(WORDS[1]) == 104
