"""JPEG: baseline and progressive, 8 bits, Huffman coded, 1, 3 or 4 components sampled up to 2x2."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from functools import lru_cache
from math import cos, pi, sqrt

import numpy as np

from pixelloom.sources.codecs import Image, image, need, opaque


def zigzag() -> list[int]:
    """Natural place of each coefficient in scan order, along the diagonals."""
    cells = [(x + y, y if (x + y) % 2 else x, y * 8 + x) for y in range(8) for x in range(8)]
    return [place for _, _, place in sorted(cells)]


ORDER = np.array(zigzag())
#: Cosine basis in 14 bits: row u, column x.
BASIS = np.array([[round(16384 * cos((2 * x + 1) * u * pi / 16) / (sqrt(2) if u == 0 else 1)) for x in range(8)] for u in range(8)], np.int64)


@dataclass
class Component:
    number: int
    h: int
    v: int
    quant: int
    wide: int = 0
    tall: int = 0
    blocks: np.ndarray | None = None  # (tall, wide, 64) in scan order
    dc: int = 0
    ac: int = 0
    before: int = 0


class Bits:
    """Bits of one restart interval, stuffing removed; zeros follow its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.store, self.have = data, 0, 0, 0

    def fill(self, n: int) -> None:
        while self.have < n:
            self.store = self.store << 8 | (self.data[self.at] if self.at < len(self.data) else 0)
            self.at += 1
            self.have += 8
        need(self.at <= len(self.data) + 64, "truncated jpeg")

    def read(self, n: int) -> int:
        if not n:
            return 0
        self.fill(n)
        self.have -= n
        v = self.store >> self.have
        self.store &= (1 << self.have) - 1
        return v

    def symbol(self, table: list[int]) -> int:
        self.fill(16)
        found = table[self.store >> (self.have - 16)]
        need(found, "jpeg decode failed")
        self.have -= found >> 8
        self.store &= (1 << self.have) - 1
        return found & 255

    def signed(self, n: int) -> int:
        v = self.read(n)
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def huffman(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits ahead, length << 8 | symbol of the code that starts them; 0 where there is none."""
    table, code, k = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            need(code < 1 << length, "invalid huffman table")
            span = 1 << (16 - length)
            start = code * span
            table[start : start + span] = [length << 8 | symbols[k]] * span
            code, k = code + 1, k + 1
        code <<= 1
    return table


def row(first: int) -> list[int]:
    """Symbols of a run length with sizes up to 10, where codes are 16 bits long."""
    return list(range(first, (first & 0xF0) + 11))


#: Codes of each length, and symbols, of the standard's tables, which stand in for tables a file leaves out: fixed values.
DC_COUNTS = (0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0)
DC_COLOR_COUNTS = (0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0)
AC_COUNTS = (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125)
AC_COLOR_COUNTS = (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119)
AC_SYMBOLS = [
    0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08,
    0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82,
    *row(0x09), *row(0x16), *row(0x25), *row(0x34), *row(0x43), *row(0x53), *row(0x63), *row(0x73), *row(0x83), *row(0x92), *row(0xA2), *row(0xB2),
    *row(0xC2), *row(0xD2), *row(0xE1), *row(0xF1),
]
AC_COLOR_SYMBOLS = [
    0x00, 0x01, 0x02, 0x03, 0x11, 0x04, 0x05, 0x21, 0x31, 0x06, 0x12, 0x41, 0x51, 0x07, 0x61, 0x71, 0x13, 0x22, 0x32, 0x81, 0x08, 0x14, 0x42, 0x91,
    0xA1, 0xB1, 0xC1, 0x09, 0x23, 0x33, 0x52, 0xF0, 0x15, 0x62, 0x72, 0xD1, 0x0A, 0x16, 0x24, 0x34, 0xE1, 0x25, 0xF1,
    *row(0x17), *row(0x26), *row(0x35), *row(0x43), *row(0x53), *row(0x63), *row(0x73), *row(0x82), *row(0x92), *row(0xA2), *row(0xB2), *row(0xC2),
    *row(0xD2), *row(0xE2), *row(0xF2),
]


@lru_cache(maxsize=1)
def standard_tables() -> dict[int, list[int]]:
    """The standard's tables by class and number."""
    plain = range(12)
    given = {0: (DC_COUNTS, plain), 1: (DC_COLOR_COUNTS, plain), 16: (AC_COUNTS, AC_SYMBOLS), 17: (AC_COLOR_COUNTS, AC_COLOR_SYMBOLS)}
    return {number: huffman(bytes(counts), bytes(symbols)) for number, (counts, symbols) in given.items()}


@dataclass
class State:
    width: int = 0
    height: int = 0
    progressive: bool = False
    parts: list[Component] = field(default_factory=list)
    quants: dict[int, np.ndarray] = field(default_factory=dict)
    tables: dict[int, list[int]] = field(default_factory=dict)
    restart: int = 0
    transform: int = -1
    eobrun: int = 0


def segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Restart intervals of the scan at a place, and where the next marker is."""
    parts, start = [], at
    while True:
        k = data.find(b"\xff", at)
        if k < 0 or k + 1 >= len(data):
            parts.append(data[start:])
            return [p.replace(b"\xff\0", b"\xff") for p in parts], len(data)
        mark = data[k + 1]
        if mark == 0 or mark == 0xFF:
            at = k + (2 if mark == 0 else 1)
        elif 0xD0 <= mark <= 0xD7:
            parts.append(data[start:k])
            start = at = k + 2
        else:
            parts.append(data[start:k])
            return [p.replace(b"\xff\0", b"\xff") for p in parts], k


def frame(s: State, body: bytes, progressive: bool) -> None:
    need(len(body) >= 6, "invalid SOF length")
    bits, s.height, s.width, n = struct.unpack_from(">BHHB", body)
    need(bits == 8, "only 8-bit JPEG supported")
    need(n in (1, 3, 4), "unsupported component count")
    need(s.width and s.height and len(body) >= 6 + 3 * n, "invalid SOF")
    s.progressive = progressive
    s.parts = [Component(a, b >> 4, b & 15, q) for a, b, q in (body[6 + 3 * k : 9 + 3 * k] for k in range(n))]
    need(all(1 <= c.h <= 2 and 1 <= c.v <= 2 for c in s.parts), "unsupported sampling factors")
    across, down = mcus(s)
    for c in s.parts:
        c.wide, c.tall = across * c.h, down * c.v
        c.blocks = np.zeros((c.tall, c.wide, 64), np.int64)


def mcus(s: State) -> tuple[int, int]:
    return -(-s.width // (8 * max(c.h for c in s.parts))), -(-s.height // (8 * max(c.v for c in s.parts)))


def places(s: State, used: list[Component]):
    """The blocks of each unit of a scan: MCUs of several components, or the real blocks of one."""
    if len(used) == 1:
        c = used[0]
        wide = -(-(-(-s.width * c.h // max(p.h for p in s.parts))) // 8)
        tall = -(-(-(-s.height * c.v // max(p.v for p in s.parts))) // 8)
        for y in range(tall):
            for x in range(wide):
                yield [(c, y, x)]
        return
    across, down = mcus(s)
    for my in range(down):
        for mx in range(across):
            yield [(c, my * c.v + j, mx * c.h + i) for c in used for j in range(c.v) for i in range(c.h)]


def whole_block(bits: Bits, c: Component, out: np.ndarray, s: State) -> None:
    c.before += bits.signed(bits.symbol(s.tables[c.dc]))
    out[0] = c.before
    k, ac = 1, s.tables[16 | c.ac]
    while k < 64:
        v = bits.symbol(ac)
        run, size = v >> 4, v & 15
        if not size:
            if run != 15:
                return
            k += 16
            continue
        k += run
        need(k < 64, "jpeg decode failed")
        out[k] = bits.signed(size)
        k += 1


def first_ac(bits: Bits, c: Component, out: np.ndarray, s: State, low: int, high: int, shift: int) -> None:
    if s.eobrun:
        s.eobrun -= 1
        return
    k, ac = low, s.tables[16 | c.ac]
    while k <= high:
        v = bits.symbol(ac)
        run, size = v >> 4, v & 15
        if not size:
            if run != 15:
                s.eobrun = (1 << run) + bits.read(run) - 1
                return
            k += 16
            continue
        k += run
        need(k <= high, "jpeg decode failed")
        out[k] = bits.signed(size) << shift
        k += 1


def more_ac(bits: Bits, c: Component, out: np.ndarray, s: State, low: int, high: int, shift: int) -> None:
    """Refine known coefficients by a bit each, and place new ones of one bit."""
    bit = 1 << shift

    def refine(k: int) -> None:
        if bits.read(1) and not abs(int(out[k])) & bit:
            out[k] += bit if out[k] > 0 else -bit

    k, ac = low, s.tables[16 | c.ac]
    while k <= high and not s.eobrun:
        v = bits.symbol(ac)
        run, size = v >> 4, v & 15
        new = 0
        if size:
            new = bit if bits.read(1) else -bit
        elif run != 15:
            s.eobrun = (1 << run) + bits.read(run)
            break
        while k <= high:
            if out[k]:
                refine(k)
            elif run == 0:
                if new:
                    out[k] = new
                k += 1
                break
            else:
                run -= 1
            k += 1
    if s.eobrun:
        for j in range(k, high + 1):
            if out[j]:
                refine(j)
        s.eobrun -= 1


def scan(s: State, head: bytes, parts: list[bytes]) -> None:
    n = head[0] if head else 0
    need(1 <= n <= len(s.parts) and len(head) >= 4 + 2 * n, "invalid SOS")
    used = []
    for k in range(n):
        c = next((p for p in s.parts if p.number == head[1 + 2 * k]), None)
        need(c is not None, "scan component not found")
        c.dc, c.ac = head[2 + 2 * k] >> 4, head[2 + 2 * k] & 15
        used.append(c)
    low, high, steps = head[1 + 2 * n : 4 + 2 * n]
    upper, shift = steps >> 4, steps & 15
    if s.progressive:
        need(low <= high < 64 and shift <= 13 and upper <= 13 and not (upper and shift >= upper), "unsupported JPEG scan")
        need(high == 0 or n == 1 and low > 0, "invalid AC scan")
    else:
        need(n == len(s.parts) and (low, high, steps) == (0, 63, 0), "unsupported JPEG scan")
    needs_dc, needs_ac = not (s.progressive and (low or upper)), not s.progressive or low > 0
    need(all((not needs_dc or c.dc in s.tables) and (not needs_ac or 16 | c.ac in s.tables) for c in used), "missing huffman table")
    interval, bits = 0, None
    for unit, blocks in enumerate(places(s, used)):
        if bits is None or s.restart and unit % s.restart == 0:
            need(interval < len(parts), "jpeg restart marker error")
            bits, interval, s.eobrun = Bits(parts[interval]), interval + 1, 0
            for c in used:
                c.before = 0
        for c, y, x in blocks:
            out = c.blocks[y, x]
            if not s.progressive:
                whole_block(bits, c, out, s)
            elif low:
                (more_ac if upper else first_ac)(bits, c, out, s, low, high, shift)
            elif upper:
                out[0] |= bits.read(1) << shift
            else:
                c.before += bits.signed(bits.symbol(s.tables[c.dc]))
                out[0] = c.before << shift


def plane(s: State, c: Component) -> np.ndarray:
    """Samples of a component at the image's size, by exact integer transforms and nearest upsampling."""
    need(c.quant in s.quants, "missing quant table")
    natural = np.zeros((c.tall * c.wide, 64), np.int64)
    natural[:, ORDER] = c.blocks.reshape(-1, 64) * s.quants[c.quant]
    flat = np.einsum("vy,nvu,ux->nyx", BASIS, natural.reshape(-1, 8, 8), BASIS, optimize=True)
    done = (((flat + (1 << 29)) >> 30) + 128).clip(0, 255)
    rows = done.reshape(c.tall, c.wide, 8, 8).transpose(0, 2, 1, 3).reshape(c.tall * 8, c.wide * 8)
    y = np.arange(s.height) * c.v // max(p.v for p in s.parts)
    x = np.arange(s.width) * c.h // max(p.h for p in s.parts)
    return rows[y][:, x]


def colored(s: State) -> np.ndarray:
    p = [plane(s, c) for c in s.parts]
    if len(p) == 1:
        return np.dstack([p[0]] * 3)
    cb, cr = p[1] - 128, p[2] - 128
    rgb = np.dstack([p[0] + (91881 * cr >> 16), p[0] - (22554 * cb + 46802 * cr >> 16), p[0] + (116130 * cb >> 16)]).clip(0, 255)
    if len(p) == 3:
        return rgb
    if s.transform == 2:
        return (rgb - p[3][..., None]).clip(0, 255)
    return (255 - (np.dstack(p[:3]) + p[3][..., None])).clip(0, 255)


def decode(data: bytes) -> Image:
    need(data[:2] == b"\xff\xd8", "not a JPEG")
    s, at, scans = State(), 2, 0
    while at + 1 < len(data):
        if data[at] != 0xFF or data[at + 1] in (0, 0xFF):
            at += 1
            continue
        mark = data[at + 1]
        at += 2
        if mark == 0xD9:
            break
        if mark == 1 or 0xD0 <= mark <= 0xD8:
            continue
        need(at + 2 <= len(data), "truncated jpeg")
        size = struct.unpack_from(">H", data, at)[0]
        need(size >= 2 and at + size <= len(data), "invalid segment length")
        body = data[at + 2 : at + size]
        at += size
        if mark in (0xC0, 0xC2):
            frame(s, body, mark == 0xC2)
        elif mark == 0xDB:
            quant_tables(s, body)
        elif mark == 0xC4:
            huffman_tables(s, body)
        elif mark == 0xDD:
            need(len(body) >= 2, "invalid DRI")
            s.restart = struct.unpack_from(">H", body)[0]
        elif mark == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            s.transform = body[11]
        elif mark == 0xDA:
            need(s.parts, "missing SOF")
            parts, at = segments(data, at)
            s.tables = standard_tables() | s.tables
            scan(s, body, parts)
            scans += 1
            if not s.progressive:
                break
        else:
            need(not 0xC1 <= mark <= 0xCF or mark in (0xC8, 0xCC), "jpeg decode failed")
    need(s.parts, "missing SOF")
    need(scans, "missing SOS")
    return image(opaque(colored(s).astype(np.uint8)))


def quant_tables(s: State, body: bytes) -> None:
    at = 0
    while at < len(body):
        wide, number = body[at] >> 4, body[at] & 15
        need(wide <= 1, "unsupported quant precision")
        need(number < 4, "invalid quant table")
        size = 128 if wide else 64
        need(at + 1 + size <= len(body), "invalid quant table length")
        s.quants[number] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int64)
        at += 1 + size


def huffman_tables(s: State, body: bytes) -> None:
    at = 0
    while at < len(body):
        need(at + 17 <= len(body), "invalid huffman table length")
        kind, counts = body[at], body[at + 1 : at + 17]
        n = sum(counts)
        need(at + 17 + n <= len(body) and n <= 256, "invalid huffman table length")
        s.tables[kind >> 4 << 4 | kind & 15] = huffman(counts, body[at + 17 : at + 17 + n])
        at += 17 + n
