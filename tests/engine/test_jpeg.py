from __future__ import annotations

import struct

import numpy as np
import pytest

from pixelloom.sources.codecs import ImageError, jpeg

BASE = jpeg.BASIS / 16384.0 / 2


def segment(mark, body):
    return bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body


class Writer:
    """Bits with a table that gives each symbol in use the same length."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> k & 1 for k in reversed(range(n))]

    def done(self):
        self.bits += [1] * (-len(self.bits) % 8)
        raw = np.packbits(self.bits).tobytes().replace(b"\xff", b"\xff\0")
        self.bits = []
        return raw


DC, AC = list(range(12)), [v for v in range(256) if v & 15 <= 10 and (v & 15 or v >> 4 <= 15)]


def table(kind, symbols):
    return segment(0xC4, bytes([kind]) + bytes([len(symbols) if k == 8 else 0 for k in range(1, 17)]) + bytes(symbols))


def size_of(v):
    return int(abs(v)).bit_length()


def value(w, v):
    n = size_of(v)
    w.put(int(v) if v >= 0 else int(v) + (1 << n) - 1, n)


def coefficients(plane):
    h, w = plane.shape
    blocks = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3).astype(float) - 128
    # The decoder multiplies by BASE on both sides; its transpose inverts that.
    freq = np.einsum("uy,abyx,vx->abuv", BASE, blocks, BASE)
    return np.round(freq).astype(int).reshape(h // 8, w // 8, 64)[:, :, jpeg.ORDER]


def put_block(w, block, before):
    d = int(block[0]) - before
    w.put(DC.index(size_of(d)), 8)
    value(w, d)
    run = 0
    for v in block[1:]:
        if not v:
            run += 1
            continue
        while run > 15:
            w.put(AC.index(0xF0), 8)
            run -= 16
        w.put(AC.index(run << 4 | size_of(v)), 8)
        value(w, v)
        run = 0
    if run:
        w.put(AC.index(0), 8)
    return int(block[0])


def head(h, w, sampling, sof=0xC0, restart=0):
    n = len(sampling)
    out = b"\xff\xd8" + segment(0xDB, b"\0" + b"\1" * 64) + table(0, DC) + table(0x10, AC)
    out += segment(sof, struct.pack(">BHHB", 8, h, w, n) + b"".join(bytes([k + 1, s << 4 | t, 0]) for k, (s, t) in enumerate(sampling)))
    return out + (segment(0xDD, struct.pack(">H", restart)) if restart else b"")


def baseline(planes, sampling, h, w, restart=0):
    coefs = [coefficients(p) for p in planes]
    out = head(h, w, sampling, restart=restart) + segment(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0]) for k in range(len(planes))) + bytes([0, 63, 0]))
    wr, before, unit, marks = Writer(), [0] * len(planes), 0, 0
    down, across = coefs[0].shape[0] // sampling[0][1], coefs[0].shape[1] // sampling[0][0]
    for my in range(down):
        for mx in range(across):
            if restart and unit and unit % restart == 0:
                out += wr.done() + bytes([0xFF, 0xD0 + marks % 8])
                marks, before = marks + 1, [0] * len(planes)
            unit += 1
            for k, (a, b) in enumerate(sampling):
                for j in range(b):
                    for i in range(a):
                        before[k] = put_block(wr, coefs[k][my * b + j, mx * a + i], before[k])
    return out + wr.done() + b"\xff\xd9"


def smooth(h, w, seed):
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 60 * np.sin(x / 5 + seed) + 50 * np.cos(y / 7), 0, 255).astype(int)


@pytest.mark.parametrize("restart", [0, 2])
def test_gray(restart):
    p = smooth(24, 32, 0)
    got = jpeg.decode(baseline([p], [(1, 1)], 21, 30, restart))
    assert got.rgba.shape == (21, 30, 4)
    assert abs(got.rgba[..., 0].astype(int) - p[:21, :30]).max() <= 2


@pytest.mark.parametrize("sampling", [[(1, 1)] * 3, [(2, 2), (1, 1), (1, 1)], [(2, 1), (1, 1), (1, 1)]])
def test_color(sampling):
    a, b = sampling[0]
    y, cb, cr = smooth(32, 32, 0), smooth(32 // b, 32 // a, 1), smooth(32 // b, 32 // a, 2)
    got = jpeg.decode(baseline([y, cb, cr], sampling, 32, 32)).rgba.astype(int)
    cb, cr = (np.repeat(np.repeat(p, b, 0), a, 1) - 128 for p in (cb, cr))
    want = np.dstack([y + 1.402 * cr, y - 0.344 * cb - 0.714 * cr, y + 1.772 * cb]).clip(0, 255)
    assert abs(got[..., :3] - want).max() <= 6


def test_progressive_equals_baseline():
    p = smooth(24, 40, 3)
    c = coefficients(p)
    want = jpeg.decode(baseline([p], [(1, 1)], 24, 40)).rgba
    out = head(24, 40, [(1, 1)], 0xC2)

    def scan(low, high, steps):
        return segment(0xDA, bytes([1, 1, 0, low, high, steps]))

    w, before = Writer(), 0
    for b in c.reshape(-1, 64):  # DC without its lowest bit
        v = int(b[0]) >> 1
        w.put(DC.index(size_of(v - before)), 8)
        value(w, v - before)
        before = v
    out += scan(0, 0, 0x01) + w.done()
    for b in c.reshape(-1, 64):
        w.put(int(b[0]) & 1, 1)
    out += scan(0, 0, 0x10) + w.done()

    def shifted(v):
        return int(abs(v)) >> 1 if v > 0 else -(int(abs(v)) >> 1)

    for b in c.reshape(-1, 64):  # AC without its lowest bit, no end-of-block runs
        run = 0
        for v in map(shifted, b[1:]):
            if not v:
                run += 1
                continue
            while run > 15:
                w.put(AC.index(0xF0), 8)
                run -= 16
            w.put(AC.index(run << 4 | size_of(v)), 8)
            value(w, v)
            run = 0
        if run:
            w.put(AC.index(0), 8)
    out += scan(1, 63, 0x01) + w.done()
    for b in c.reshape(-1, 64):  # the lowest bit: new ones are placed, known ones corrected
        known = [shifted(v) for v in b]
        last = max([k for k in range(1, 64) if b[k] and not known[k]], default=0)
        run, pending = 0, []
        for k in range(1, last + 1):
            if known[k]:
                pending.append(abs(int(b[k])) & 1)
            elif not b[k]:
                run += 1
                if run == 16:
                    w.put(AC.index(0xF0), 8)
                    for p_ in pending:
                        w.put(p_, 1)
                    run, pending = 0, []
            else:
                w.put(AC.index(run << 4 | 1), 8)
                w.put(int(b[k] > 0), 1)
                for p_ in pending:
                    w.put(p_, 1)
                run, pending = 0, []
        rest = pending + [abs(int(b[k])) & 1 for k in range(last + 1, 64) if known[k]]
        if last < 63:
            w.put(AC.index(0), 8)
            for p_ in rest:
                w.put(p_, 1)
    out += scan(1, 63, 0x10) + w.done()
    assert np.array_equal(jpeg.decode(out + b"\xff\xd9").rgba, want)


def test_tables():
    assert jpeg.ORDER[:8].tolist() == [0, 1, 8, 16, 9, 2, 3, 10] and jpeg.ORDER[-1] == 63
    assert jpeg.BASIS[0, 0] == 11585 and jpeg.BASIS[1].tolist()[:4] == [16069, 13623, 9102, 3196]


@pytest.mark.parametrize("data, text", [
    (b"\xff\xd8", "missing SOF"), (b"GIF", "not a JPEG"), (head(8, 8, [(1, 1)]), "missing SOS"), (head(8, 8, [(3, 1)]), "unsupported sampling factors"),
    (b"\xff\xd8" + segment(0xC0, struct.pack(">BHHB", 12, 8, 8, 1) + b"\1\x11\0"), "only 8-bit JPEG supported"),
    (b"\xff\xd8" + segment(0xDB, b"\0\1"), "invalid quant table length"),
])
def test_errors(data, text):
    with pytest.raises(ImageError, match=text):
        jpeg.decode(data)


def ifd(entries, blobs):
    """A little-endian TIFF of one IFD; a blob's tag gets its offset."""
    out = bytearray(b"II*\0\0\0\0\0")
    at = {}
    for name, raw in blobs.items():
        at[name] = len(out)
        out += raw + b"\0" * (len(raw) % 2)
    out[4:8] = struct.pack("<I", len(out))
    out += struct.pack("<H", len(entries))
    for tag, kind, n, v in sorted(entries):
        v = at[v] if isinstance(v, str) else v
        out += struct.pack("<HHI", tag, kind, n) + (struct.pack("<HH", *v) if isinstance(v, tuple) else struct.pack("<I", v))
    return bytes(out) + b"\0\0\0\0"


def test_jpeg_in_tiff():
    p = smooth(16, 16, 1)
    whole = baseline([p], [(1, 1)], 16, 16)
    want = jpeg.decode(whole).rgba
    cut = whole.index(b"\xff\xc0")
    tables, stream = whole[:cut] + b"\xff\xd9", b"\xff\xd8" + whole[cut:]
    from pixelloom.sources.codecs import tiff

    common = [(256, 4, 1, 16), (257, 4, 1, 16), (258, 3, 1, 8), (262, 3, 1, 1), (277, 3, 1, 1)]
    new = ifd([*common, (259, 3, 1, 7), (273, 4, 1, "s"), (279, 4, 1, len(stream)), (347, 7, len(tables), "t")], {"t": tables, "s": stream})
    assert np.array_equal(tiff.decode(new).rgba, want)
    old = ifd([*common, (259, 3, 1, 6), (513, 4, 1, "s"), (514, 4, 1, len(whole)), (274, 3, 1, 3)], {"s": whole})
    assert np.array_equal(tiff.decode(old).rgba, want[::-1, ::-1])


@pytest.mark.parametrize("said", [True, False])
def test_subsampled_tiff(said):
    from pixelloom.sources.codecs import tiff

    units = bytes([10, 20, 30, 40, 128, 128, 50, 60, 70, 80, 128, 255])
    entries = [(256, 4, 1, 3), (257, 4, 1, 2), (258, 3, 1, 8), (259, 3, 1, 1), (262, 3, 1, 6), (273, 4, 1, "s"), (277, 3, 1, 3), (278, 4, 1, 2), (279, 4, 1, 12)]
    got = tiff.decode(ifd(entries + ([(530, 3, 2, (2, 2))] if said else []), {"s": units})).rgba
    assert got[..., :3][:, :2, 0].tolist() == [[10, 20], [30, 40]] and got[0, 2].tolist() == [228, 0, 50, 255]
