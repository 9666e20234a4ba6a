"""WebP: the container and the lossless format. Lossy frames become errors."""

from __future__ import annotations

import struct

import numpy as np

from pixelloom.sources.codecs import Image, image, need

#: Neighbours (dx, dy) that the first 120 distance codes stand for, fixed values.
NEAR = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1),
    (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3),
    (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7),
    (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)
#: Order in which lengths of code-length codes are stored, fixed values.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
HASH = 0x1E35A7BD
BLACK = 0xFF000000


class Bits:
    """Bits, least significant first; zeros follow the end for a while."""

    def __init__(self, data: bytes):
        self.data, self.at, self.store, self.have = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.have < n:
            if self.at < len(self.data):
                self.store |= self.data[self.at] << self.have
            self.at += 1
            self.have += 8
        need(self.at <= len(self.data) + 8, "truncated VP8L data")

    def read(self, n: int) -> int:
        self.fill(n)
        v = self.store & (1 << n) - 1
        self.store >>= n
        self.have -= n
        return v


class Code:
    """A canonical prefix code; a code with one symbol takes no bits."""

    def __init__(self, lengths: list[int]):
        used = [(n, k) for k, n in enumerate(lengths) if n]
        need(used, "invalid VP8L prefix code")
        self.only = used[0][1] if len(used) == 1 else None
        self.most = max(n for n, _ in used)
        self.table: dict[tuple[int, int], int] = {}
        code, before = 0, 0
        for n, symbol in sorted(used):
            code <<= n - before
            need(code < 1 << n, "invalid VP8L prefix code")
            self.table[n, code] = symbol
            code, before = code + 1, n

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        code = 0
        for n in range(1, self.most + 1):
            code = code << 1 | bits.read(1)
            symbol = self.table.get((n, code))
            if symbol is not None:
                return symbol
        need(False, "VP8L decode failed")


def read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        for symbol in (first, bits.read(8)) if two else (first,):
            need(symbol < size, "invalid VP8L prefix code")
            lengths[symbol] = 1
        return Code(lengths)
    inner = [0] * 19
    for k in range(4 + bits.read(4)):
        inner[LENGTH_ORDER[k]] = bits.read(3)
    code = Code(inner)
    limit = size
    if bits.read(1):
        limit = 2 + bits.read(2 + 2 * bits.read(3))
        need(limit <= size, "invalid VP8L prefix code")
    at, before = 0, 8
    while at < limit:
        s = code.read(bits)
        if s < 16:
            lengths[at] = s
            before = s or before
            at += 1
            continue
        value, extra, base = ((before, 2, 3), (0, 3, 3), (0, 7, 11))[s - 16]
        for _ in range(base + bits.read(extra)):
            if at < limit:
                lengths[at] = value
                at += 1
    return Code(lengths)


def amount(bits: Bits, code: int) -> int:
    """A length or distance of a prefix and extra bits."""
    if code < 4:
        return code + 1
    extra = (code - 2) >> 1
    return ((2 + (code & 1)) << extra) + bits.read(extra) + 1


def pixels(bits: Bits, width: int, height: int, main: bool) -> list[int]:
    """Entropy-coded ARGB numbers of an image or of a transform's data."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    need(cache_bits <= 11, "invalid VP8L color cache bits")
    cache = [0] * (1 << cache_bits) if cache_bits else []
    tile, groups, across = 0, [0], 1
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across = -(-width >> tile)
        groups = [p >> 8 & 0xFFFF for p in pixels(bits, across, -(-height >> tile), False)]
    sizes = (256 + 24 + len(cache), 256, 256, 256, 40)
    codes = [[read_code(bits, n) for n in sizes] for _ in range(max(groups) + 1)]
    out: list[int] = []
    total = width * height

    def keep(p: int) -> None:
        out.append(p)
        if cache:
            cache[(p * HASH & 0xFFFFFFFF) >> (32 - cache_bits)] = p

    while len(out) < total:
        y, x = divmod(len(out), width)
        green, red, blue, alpha, far = codes[groups[(y >> tile) * across + (x >> tile)] if tile else 0]
        g = green.read(bits)
        if g < 256:
            r, b = red.read(bits), blue.read(bits)
            keep(alpha.read(bits) << 24 | r << 16 | g << 8 | b)
        elif g < 280:
            n = amount(bits, g - 256)
            d = amount(bits, far.read(bits))
            if d <= 120:
                dx, dy = NEAR[d - 1]
                d = max(1, dx + dy * width)
            else:
                d -= 120
            need(d <= len(out), "VP8L invalid distance")
            for _ in range(min(n, total - len(out))):
                keep(out[-d])
        else:
            need(g - 280 < len(cache), "VP8L invalid cache index")
            keep(cache[g - 280])
    return out


def split(p: int) -> tuple[int, int, int, int]:
    return p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255


def joined(parts) -> int:
    a, r, g, b = parts
    return a << 24 | r << 16 | g << 8 | b


def mean(p: int, q: int) -> int:
    return joined((a + b) >> 1 for a, b in zip(split(p), split(q)))


def guess(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """The fourteen predictions from neighbours."""
    if mode <= 4:
        return (BLACK, left, top, right, corner)[mode]
    if mode == 5:
        return mean(mean(left, right), top)
    if mode <= 9:
        return mean(*((left, corner), (left, top), (corner, top), (top, right))[mode - 6])
    if mode == 10:
        return mean(mean(left, corner), mean(top, right))
    lt, tp, cn = split(left), split(top), split(corner)
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(tp, cn))
        to_top = sum(abs(l - c) for l, c in zip(lt, cn))
        return left if to_left < to_top else top
    if mode == 12:
        return joined(min(255, max(0, l + t - c)) for l, t, c in zip(lt, tp, cn))
    half = split(mean(left, top))
    return joined(min(255, max(0, h + int((h - c) / 2))) for h, c in zip(half, cn))


def add(p: int, q: int) -> int:
    return joined((a + b) & 255 for a, b in zip(split(p), split(q)))


def unpredicted(px: list[int], width: int, height: int, data: list[int], size: int) -> list[int]:
    across = -(-width >> size)
    out = list(px)
    for at in range(len(out)):
        y, x = divmod(at, width)
        if not at:
            base = BLACK
        elif not y:
            base = out[at - 1]
        elif not x:
            base = out[at - width]
        else:
            mode = data[(y >> size) * across + (x >> size)] >> 8 & 15
            # Past the last column the upper right neighbour is this row's first pixel.
            base = guess(mode if mode <= 13 else 0, out[at - 1], out[at - width], out[at - width - 1], out[at - width + 1])
        out[at] = add(out[at], base)
    return out


def signed(v: np.ndarray) -> np.ndarray:
    return v.astype(np.uint8).astype(np.int8).astype(np.int64)


def uncrossed(px: list[int], width: int, height: int, data: list[int], size: int) -> list[int]:
    p = np.array(px, np.int64).reshape(height, width)
    y, x = np.mgrid[:height, :width]
    t = np.array(data, np.int64)[(y >> size) * -(-width >> size) + (x >> size)]
    green = signed(p >> 8)
    red = (p >> 16) + (signed(t) * green >> 5) & 255
    blue = p + (signed(t >> 8) * green >> 5) + (signed(t >> 16) * signed(red) >> 5) & 255
    return (p & 0xFF00FF00 | red << 16 | blue).reshape(-1).tolist()


def indexed(px: list[int], width: int, height: int, table: list[int], bits: int) -> list[int]:
    """Packed indices in the green channel to colours; an index beyond the table is transparent black."""
    packed = np.array(px, np.int64).reshape(height, -(-width >> bits))
    x = np.arange(width)
    each = 8 >> bits
    at = packed[:, x >> bits] >> 8 >> each * (x & (1 << bits) - 1) & (1 << each) - 1
    colors = np.zeros(256, np.int64)
    colors[: len(table)] = table
    return colors[at].reshape(-1).tolist()


def lossless(data: bytes) -> Image:
    need(len(data) >= 5 and data[0] == 0x2F, "invalid VP8L signature")
    bits = Bits(data[1:])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    need(bits.read(3) == 0, "unsupported VP8L version")
    undo, now, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        need(kind not in seen, "repeated VP8L transform")
        seen.add(kind)
        if kind in (0, 1):
            size = bits.read(3) + 2
            undo.append((unpredicted if kind == 0 else uncrossed, now, pixels(bits, -(-now >> size), -(-height >> size), False), size))
        elif kind == 2:
            undo.append((None, now, None, None))
        else:
            n = bits.read(8) + 1
            table = pixels(bits, n, 1, False)
            for k in range(1, n):
                table[k] = add(table[k], table[k - 1])
            packing = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((indexed, now, table, packing))
            now = -(-now >> packing)
    px = pixels(bits, now, height, True)
    for step, wide, given, size in reversed(undo):
        if step is None:
            p = np.array(px, np.int64)
            green = p >> 8 & 255
            px = (p & 0xFF00FF00 | (p >> 16) + green << 16 & 0xFF0000 | p + green & 255).tolist()
        else:
            px = step(px, wide, height, given, size)
    p = np.array(px, np.int64).reshape(height, width)
    return image(np.dstack([p >> 16 & 255, p >> 8 & 255, p & 255, p >> 24 & 255]))


def decode(data: bytes) -> Image:
    need(len(data) >= 12 and data[:4] == b"RIFF" and data[8:12] == b"WEBP", "invalid WebP header")
    at, found = 12, {}
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        need(at + 8 + size <= len(data), "truncated WebP chunk")
        found.setdefault(kind, data[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    need(not (found.get(b"VP8X", b"\0")[0] & 2), "animated WebP is not supported")
    if b"VP8L" in found:
        return lossless(found[b"VP8L"])
    need(b"VP8 " not in found, "lossy WebP is not supported yet")
    need(False, "missing WebP image data")
