"""TIFF and BigTIFF, both byte orders: strips and tiles, chunky and planar, integer and float samples.

Compression: none, LZW, Deflate, PackBits, CCITT, JPEG of both styles. Photometrics: grey both
ways, RGB, palette, CMYK, YCbCr with subsampling (2x2 unless said), CIELAB. A page is one IFD of the main chain, or a
SubIFD, which come after all of that chain.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from pixelloom.sources.codecs import Image, ccitt, image, jpeg, need, scaled

#: Sizes of the field types 1..18, fixed values (0 for unused numbers).
SIZES = (0, 1, 1, 2, 4, 8, 1, 1, 2, 4, 8, 4, 8, 4, 0, 0, 8, 8, 8)
INTEGERS = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}
MOST_IFDS = 10000
NONE, LZW, OLD_JPEG, JPEG, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 6, 7, 8, 32773, 32946
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, FILL, STRIPS, ORIENTATION, SAMPLES = 256, 257, 258, 259, 262, 266, 273, 274, 277
STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR, COLORS, TILE_W, TILE_H, TILES, TILE_SIZES = 278, 279, 284, 317, 320, 322, 323, 324, 325
SUBIFDS, EXTRA, FORMAT, JPEG_TABLES, JPEG_START, JPEG_SIZE, SUBSAMPLING = 330, 338, 339, 347, 513, 514, 530
T4_OPTIONS = 292


@dataclass
class File:
    data: bytes
    order: str
    big: bool

    def number(self, at: int, code: str) -> int:
        need(at + struct.calcsize(code) <= len(self.data), "truncated TIFF data")
        return struct.unpack_from(self.order + code, self.data, at)[0]

    def ifd(self, at: int) -> tuple[dict[int, tuple[int, int, tuple]], int]:
        """(tag: (type, count, values)) and the next IFD's offset. Values of other types are raw bytes."""
        count, start, entry, wide = (self.number(at, "Q"), at + 8, 20, "Q") if self.big else (self.number(at, "H"), at + 2, 12, "I")
        need(count and start + count * entry <= len(self.data), "truncated TIFF IFD")
        room, tags = (8 if self.big else 4), {}
        for k in range(count):
            e = start + k * entry
            tag, kind = self.number(e, "H"), self.number(e + 2, "H")
            n = self.number(e + 4, wide)
            size = (SIZES[kind] if kind < len(SIZES) else 0) * n
            at_value = e + entry - room if size <= room else self.number(e + entry - room, wide)
            if at_value + size > len(self.data):
                continue
            if kind in INTEGERS and n:
                values = struct.unpack_from(f"{self.order}{n}{INTEGERS[kind]}", self.data, at_value)
            else:
                values = (self.data[at_value : at_value + size],)
            tags[tag] = (kind, n, values)
        return tags, self.number(start + count * entry, wide)


def opened(data: bytes) -> tuple[File, int]:
    """The file and its first IFD's offset."""
    need(len(data) >= 8, "file too small")
    need(data[:2] in (b"II", b"MM"), "invalid TIFF byte order")
    f = File(data, "<" if data[:2] == b"II" else ">", False)
    magic = f.number(2, "H")
    need(magic in (42, 43), "invalid TIFF magic")
    f.big = magic == 43
    if f.big:
        need(f.number(4, "H") == 8 and f.number(6, "H") == 0, "invalid BigTIFF header")
    return f, f.number(8, "Q") if f.big else f.number(4, "I")


def pages(data: bytes) -> tuple[File, list[dict]]:
    """IFDs of the main chain, then their SubIFDs."""
    f, at = opened(data)
    chain, seen = [], set()
    while at and at not in seen and len(chain) < MOST_IFDS:
        seen.add(at)
        tags, at = f.ifd(at)
        chain.append(tags)
    below = []
    for tags in chain:
        for sub in tags.get(SUBIFDS, (0, 0, ()))[2]:
            if isinstance(sub, int):
                below.append(f.ifd(sub)[0])
    return f, chain + below


def tags_of(data: bytes) -> list[tuple[int, int, int, int, list[int]]]:
    """(ifd, tag, type, count, values) of every entry."""
    _, found = pages(data)
    return [(k, tag, kind, n, [v for v in values if isinstance(v, int)]) for k, tags in enumerate(found) for tag, (kind, n, values) in sorted(tags.items())]


def lzw(data: bytes, limit: int) -> bytes:
    """Codes, most significant bit first, whose width grows one code early."""
    base = [bytes([k]) for k in range(256)] + [b"", b""]
    table, width, before = list(base), 9, None
    out, size, store, have = [], 0, 0, 0
    for byte in data:
        store = store << 8 | byte
        have += 8
        if have < width:
            continue
        have -= width
        code = store >> have
        store &= (1 << have) - 1
        if code == 257 or size >= limit:
            break
        if code == 256:
            table, width, before = list(base), 9, None
            continue
        if before is None:
            need(code < 256, "invalid LZW code")
            entry = table[code]
        else:
            need(code <= len(table), "invalid LZW code")
            entry = table[code] if code < len(table) else before + before[:1]
            if len(table) < 4096:
                table.append(before + entry[:1])
                if len(table) >= (1 << width) - 1 and width < 12:
                    width += 1
        out.append(entry)
        size += len(entry)
        before = entry
    return b"".join(out)


def packbits(data: bytes, limit: int) -> bytes:
    out, at, size = [], 0, 0
    while at < len(data) and size < limit:
        n = data[at]
        at += 1
        if n == 128:
            continue
        part = data[at : at + n + 1] if n < 128 else data[at : at + 1] * (257 - n)
        at += n + 1 if n < 128 else 1
        out.append(part)
        size += len(part)
    return b"".join(out)


def deflated(data: bytes) -> bytes:
    for bits in (15, -15):
        try:
            return zlib.decompressobj(bits).decompress(data)
        except zlib.error:
            continue
    need(False, "TIFF deflate failed")


def block(data: bytes, compression: int, size: int) -> bytes:
    """One strip or tile, of exactly ``size`` bytes."""
    if compression == LZW:
        data = lzw(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        data = deflated(data)
    elif compression == PACKBITS:
        data = packbits(data, size)
    else:
        need(compression == NONE, "unsupported TIFF compression")
    need(len(data) >= size, "truncated TIFF data")
    return data[:size]


def predicted(raw: bytes, rows: int, samples: int, bits: int, order: str) -> bytes:
    """Horizontal differences undone; 8 and 16 bits."""
    need(bits in (8, 16), "unsupported TIFF predictor")
    kind = np.dtype(np.uint8 if bits == 8 else f"{order}u2")
    px = np.frombuffer(raw, kind).reshape(rows, -1, samples)
    return np.add.accumulate(px.astype(kind.newbyteorder("=")), axis=1, dtype=kind.newbyteorder("=")).astype(kind).tobytes()


def samples_of(raw: bytes, rows: int, width: int, samples: int, bits: int, order: str, fill: int, real: bool) -> np.ndarray:
    """(rows, width, samples) as integers, or floats."""
    stride = (width * samples * bits + 7) // 8
    data = np.frombuffer(raw, np.uint8).reshape(rows, stride)
    if fill == 2 and bits < 8:
        data = np.packbits(np.unpackbits(data, axis=1, bitorder="little"), axis=1)
    if real:
        need(bits in (32, 64), "unsupported TIFF float size")
        return np.ascontiguousarray(data).view(f"{order}f{bits // 8}").reshape(rows, width, samples).astype(np.float64)
    if bits in (8, 16, 32):
        return np.ascontiguousarray(data).view(f"{order}u{bits // 8}").reshape(rows, width, samples).astype(np.uint32)
    need(0 < bits < 32, "unsupported TIFF bit depth")
    ones = np.unpackbits(data, axis=1)[:, : width * samples * bits].reshape(rows, width, samples, bits)
    return (ones.astype(np.uint64) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).sum(3).astype(np.uint32)


def eight(v: np.ndarray, bits: int, real: bool) -> np.ndarray:
    if real:
        v = np.where(v <= 1.0, v * 255.0, v)
        return (np.clip(v, 0, 255) + 0.5).astype(np.int64).clip(0, 255).astype(np.uint8)
    return v.astype(np.uint8) if bits == 8 else scaled(v, bits)


def decode(data: bytes, page: int = 0) -> Image:
    f, found = pages(data)
    need(0 <= page < len(found), "page index out of range")
    tags = found[page]

    def one(tag: int, default: int | None = None) -> int:
        v = tags.get(tag, (0, 0, (default,)))[2][0]
        need(isinstance(v, int), f"missing TIFF tag {tag}")
        return v

    width, height = one(WIDTH), one(HEIGHT)
    need(width and height, "invalid dimensions")
    samples, compression, photometric = one(SAMPLES, 1), one(COMPRESSION, 1), one(PHOTOMETRIC)
    if compression == OLD_JPEG and JPEG_START in tags:
        start = one(JPEG_START)
        need(start < len(data), "truncated TIFF data")
        return image(oriented(jpeg.decode(data[start : start + one(JPEG_SIZE, len(data) - start)]).rgba, one(ORIENTATION, 1)))
    all_bits = tags.get(BITS, (0, 0, (1,)))[2]
    need(len(set(all_bits)) == 1, "unsupported TIFF mixed bit depths")
    bits, fill, planar = all_bits[0], one(FILL, 1), one(PLANAR, 1) == 2 and samples > 1
    real = one(FORMAT, 1) == 3
    tiled = TILES in tags
    bw, bh = (one(TILE_W), one(TILE_H)) if tiled else (width, min(height, one(STRIP_ROWS, height)))
    need(bw and bh, "invalid TIFF block size")
    offsets, sizes = (tags.get(t, (0, 0, ()))[2] for t in ((TILES, TILE_SIZES) if tiled else (STRIPS, STRIP_SIZES)))
    across, down = -(-width // bw), -(-height // bh)
    planes, per = (samples, 1) if planar else (1, samples)
    need(len(offsets) >= across * down * planes and len(sizes) >= across * down * planes, "missing TIFF strips")
    grid = Grid(width, height, bw, bh, across, tiled)
    if compression in (JPEG, OLD_JPEG):
        need(not planar, "unsupported TIFF planar JPEG")
        tables = bytes(b for v in tags.get(JPEG_TABLES, (0, 0, ()))[2] for b in (v if isinstance(v, bytes) else [v]))
        rgba = np.zeros((height, width, 4), np.uint8)
        for k in range(across * down):
            stream = data[offsets[k] : offsets[k] + sizes[k]]
            part = jpeg.decode(tables[:-2] + stream[2:] if tables else stream).rgba
            y, x, h, w = grid.place(k)
            rgba[y : y + h, x : x + w] = part[:h, :w]
        return image(oriented(rgba, one(ORIENTATION, 1)))
    sub = tags.get(SUBSAMPLING, (0, 0, (2, 2)))[2]
    if photometric == 6 and tuple(sub) != (1, 1) and not planar:
        need(len(sub) == 2 and samples == 3 and bits == 8 and all(v in (1, 2, 4) for v in sub), "unsupported TIFF subsampling")
        out = np.zeros((height, width, 3), np.uint32)
        for k in range(across * down):
            y, x, h, w = grid.place(k)
            part = subsampled(data[offsets[k] : offsets[k] + sizes[k]], compression, bw, bh if tiled else h, *sub)
            out[y : y + h, x : x + w] = part[:h, :w]
        return image(oriented(colored(out, tags, photometric, bits, real), one(ORIENTATION, 1)))
    out = np.zeros((height, width, samples), np.float64 if real else np.uint32)
    for p in range(planes):
        for j in range(down):
            rows = bh if tiled else min(bh, height - j * bh)
            for i in range(across):
                k = (p * down + j) * across + i
                need(offsets[k] + sizes[k] <= len(data), "truncated TIFF data")
                raw = data[offsets[k] : offsets[k] + sizes[k]]
                if compression in (ccitt.ROWS, ccitt.GROUP3, ccitt.GROUP4):
                    need(per == 1 and bits == 1, "unsupported TIFF bit depth")
                    raw, fill = ccitt.decode(raw, bw, rows, compression, one(T4_OPTIONS, 0), one(FILL, 1)), 1
                else:
                    raw = block(raw, compression, rows * ((bw * per * bits + 7) // 8))
                if one(PREDICTOR, 1) == 2:
                    raw = predicted(raw, rows, per, bits, f.order)
                part = samples_of(raw, rows, bw, per, bits, f.order, fill, real)
                h, w = min(rows, height - j * bh), min(bw, width - i * bw)
                out[j * bh : j * bh + h, i * bw : i * bw + w, p : p + per] = part[:h, :w]
    return image(oriented(colored(out, tags, photometric, bits, real), one(ORIENTATION, 1)))


@dataclass
class Grid:
    """Where blocks lie in the image."""

    width: int
    height: int
    bw: int
    bh: int
    across: int
    tiled: bool

    def place(self, k: int) -> tuple[int, int, int, int]:
        """(y, x, height, width) of the part of block k that is inside."""
        j, i = divmod(k, self.across)
        return j * self.bh, i * self.bw, min(self.bh, self.height - j * self.bh), min(self.bw, self.width - i * self.bw)


def subsampled(raw: bytes, compression: int, width: int, rows: int, h: int, v: int) -> np.ndarray:
    """Units of h x v luma samples, one blue and one red difference, to full samples."""
    wide, tall = -(-width // h), -(-rows // v)
    raw = block(raw, compression, wide * tall * (h * v + 2))
    units = np.frombuffer(raw, np.uint8).reshape(tall, wide, h * v + 2)
    luma = units[..., : h * v].reshape(tall, wide, v, h).transpose(0, 2, 1, 3).reshape(tall * v, wide * h)
    chroma = [np.repeat(np.repeat(units[..., h * v + k], v, 0), h, 1) for k in range(2)]
    return np.dstack([luma, *chroma])[:rows, :width]


def colored(v: np.ndarray, tags: dict, photometric: int, bits: int, real: bool) -> np.ndarray:
    """Samples to straight RGBA."""
    base = {0: 1, 1: 1, 2: 3, 3: 1, 5: 4, 6: 3, 8: 3}.get(photometric)
    need(base is not None, "unsupported TIFF photometric")
    need(v.shape[2] >= base, "missing TIFF samples")
    if photometric == 3:
        need(COLORS in tags, "missing TIFF color map")
        table = np.array(tags[COLORS][2], np.uint32)
        n = 1 << bits
        need(len(table) >= 3 * n and int(v[..., 0].max()) < n, "invalid TIFF palette index")
        rgb = ((table[: 3 * n].reshape(3, n).T + 128) // 257).astype(np.uint8)[v[..., 0].astype(np.int64)]
    else:
        c = eight(v[..., :base], bits, real)
        if photometric in (0, 1):
            rgb = np.repeat(255 - c if photometric == 0 else c, 3, axis=2)
        elif photometric == 2:
            rgb = c
        elif photometric == 5:
            w = c.astype(np.int64)
            rgb = ((255 - w[..., :3]) * (255 - w[..., 3:]) + 127) // 255
        elif photometric == 6:
            y, cb, cr = (c[..., k].astype(np.float64) for k in range(3))
            cb, cr = cb - 128, cr - 128
            rgb = np.dstack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb])
            rgb = np.trunc(rgb).clip(0, 255)
        else:
            rgb = lab(c)
    rgb = rgb.astype(np.uint8)
    alpha = np.full(rgb.shape[:2], 255, np.uint8)
    extra = tags.get(EXTRA, (0, 0, ()))[2]
    at = next((k for k, e in enumerate(extra) if e in (1, 2)), None)
    if at is not None and v.shape[2] > base + at:
        alpha = eight(v[..., base + at], bits, real)
        if extra[at] == 1:
            a = alpha.astype(np.int64)[..., None]
            wide = ((rgb.astype(np.int64) * 255 + a // 2) // np.maximum(a, 1)) & 255
            rgb = np.where((a > 0) & (a < 255), wide, rgb).astype(np.uint8)
    return np.dstack([rgb, alpha])


def lab(c: np.ndarray) -> np.ndarray:
    """CIE L*a*b* to linear RGB, D65."""
    l, a, b = (c[..., k].astype(np.float64) for k in range(3))
    fy = (l * 100.0 / 255.0 + 16.0) / 116.0
    t = np.stack([fy + (a - 128.0) / 500.0, fy, fy - (b - 128.0) / 200.0], -1)
    xyz = np.where(t**3 > 0.008856, t**3, (t - 16.0 / 116.0) / 7.787) * [0.95047, 1.0, 1.08883]
    mixed = xyz @ np.array([[3.2406, -1.5372, -0.4986], [-0.9689, 1.8758, 0.0415], [0.0557, -0.2040, 1.0570]]).T
    return np.trunc(mixed * 255.0 + 0.5).clip(0, 255)


def oriented(rgba: np.ndarray, way: int) -> np.ndarray:
    need(1 <= way <= 8, "invalid TIFF orientation")
    if way >= 5:
        rgba = rgba.transpose(1, 0, 2)
    flip = {1: (1, 1), 2: (1, -1), 3: (-1, -1), 4: (-1, 1), 5: (1, 1), 6: (1, -1), 7: (-1, -1), 8: (-1, 1)}[way]
    return rgba[:: flip[0], :: flip[1]]
