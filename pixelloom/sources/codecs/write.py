"""Small lossless writers, for round trips: RGBA arrays to file bytes."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def bmp32(rgba: np.ndarray) -> bytes:
    """Version 4 header with bit fields, bottom-up. A zero-alpha channel stays as it is."""
    h, w = rgba.shape[:2]
    body = rgba[::-1, :, [2, 1, 0, 3]].tobytes()
    head = struct.pack("<IiiHHIIiiII", 108, w, h, 1, 32, 3, len(body), 0, 0, 0, 0)
    head += struct.pack("<4I", 0x00FF0000, 0x0000FF00, 0x000000FF, 0xFF000000) + b"BGRs" + b"\0" * 48
    return b"BM" + struct.pack("<IHHI", 14 + len(head) + len(body), 0, 0, 14 + len(head)) + head + body


def bmp24(rgb: np.ndarray) -> bytes:
    h, w = rgb.shape[:2]
    rows = np.zeros((h, (w * 24 + 31) // 32 * 4), np.uint8)
    rows[:, : w * 3] = rgb[::-1, :, 2::-1].reshape(h, -1)
    head = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, rows.size, 0, 0, 0, 0)
    return b"BM" + struct.pack("<IHHI", 54 + rows.size, 0, 0, 54) + head + rows.tobytes()


def tga32(rgba: np.ndarray, rle: bool = False) -> bytes:
    """Top-left origin, eight alpha bits; run lengths within the whole image if asked for."""
    h, w = rgba.shape[:2]
    head = struct.pack("<BBBHHBHHHHBB", 0, 0, 10 if rle else 2, 0, 0, 0, 0, 0, w, h, 32, 0x28)
    px = rgba[..., [2, 1, 0, 3]].reshape(-1, 4)
    if not rle:
        return head + px.tobytes()
    edges = np.flatnonzero(np.r_[True, (px[1:] != px[:-1]).any(1), True])
    out = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        while a < b:
            n = min(128, b - a)
            out.append(bytes([127 + n]) + px[a].tobytes())
            a += n
    return head + b"".join(out)


def png(rgba: np.ndarray, filters: tuple[int, ...] = (0, 1, 2, 3, 4), interlace: bool = False) -> bytes:
    """Colour type 6 of 8 bits; scanline filters are taken in turn."""
    from pixelloom.sources.codecs.png import PASSES, SIGNATURE

    h, w = rgba.shape[:2]

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    raw = []
    for x0, y0, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        part = rgba[y0::dy, x0::dx]
        if not part.size:
            continue
        rows = part.reshape(len(part), -1).astype(np.int64)
        for y, row in enumerate(rows):
            up = rows[y - 1] if y else np.zeros_like(row)
            left, corner = np.r_[np.zeros(4, np.int64), row[:-4]], np.r_[np.zeros(4, np.int64), up[:-4]]
            pa, pb, pc = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
            paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
            kind = filters[y % len(filters)]
            guess = (0, left, up, (left + up) // 2, paeth)[kind]
            raw.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
    head = struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, int(interlace))
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(raw))) + chunk(b"IEND", b"")


def ico(pages: list[np.ndarray], cursor: bool = False, hotspot: tuple[int, int] = (0, 0)) -> bytes:
    """Pages of 32 bits without a mask that hides anything."""
    bodies = []
    for rgba in pages:
        h, w = rgba.shape[:2]
        mask = np.zeros((h, (w + 31) // 32 * 4), np.uint8)
        bodies.append(struct.pack("<IiiHHIIiiII", 40, w, 2 * h, 1, 32, 0, 0, 0, 0, 0, 0) + rgba[::-1, :, [2, 1, 0, 3]].tobytes() + mask.tobytes())
    head, at = struct.pack("<3H", 0, 2 if cursor else 1, len(pages)), 6 + 16 * len(pages)
    for rgba, body in zip(pages, bodies):
        h, w = rgba.shape[:2]
        a, b = hotspot if cursor else (1, 32)
        head += struct.pack("<4B2H2I", w % 256, h % 256, 0, 0, a, b, len(body), at)
        at += len(body)
    return head + b"".join(bodies)


def lzw_codes(data: bytes, bits: int, msb: bool) -> bytes:
    """LZW for GIF (least significant bit first) or TIFF (most significant first, early change)."""
    clear, stop = 1 << bits, (1 << bits) + 1
    width, table, out = bits + 1, {bytes([k]): k for k in range(clear)}, []
    out.append((clear, width))
    word, free = b"", stop + 1
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        out.append((table[word], width))
        table[longer] = free
        free += 1
        if free == (1 << width) + (0 if msb else 1) and width < 12:
            width += 1
        if free >= 4094:
            out.append((clear, width))
            width, table, free = bits + 1, {bytes([k]): k for k in range(clear)}, stop + 1
        word = data[k : k + 1]
    if word:
        out.append((table[word], width))
    out.append((stop, width))
    store = have = 0
    done = bytearray()
    for code, size in out:
        if msb:
            store, have = store << size | code, have + size
            while have >= 8:
                have -= 8
                done.append(store >> have & 255)
                store &= (1 << have) - 1
        else:
            store, have = store | code << have, have + size
            while have >= 8:
                done.append(store & 255)
                store, have = store >> 8, have - 8
    if have:
        done.append(store << (8 - have) & 255 if msb else store & 255)
    return bytes(done)


def gif(frames: list[np.ndarray], palette: np.ndarray, *, delays=None, disposals=None, transparent=None, loops=None, interlace=False, places=None) -> bytes:
    """Indexed frames (h, w) with one palette of a power of two of colours."""
    bits = max(2, int(len(palette) - 1).bit_length())
    size = int(len(palette) - 1).bit_length() - 1
    height, width = frames[0].shape
    out = [b"GIF89a" + struct.pack("<HHBBB", width, height, 0x80 | size, 0, 0) + palette.astype(np.uint8).tobytes()]
    if loops is not None:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", loops) + b"\0")
    for k, f in enumerate(frames):
        h, w = f.shape
        left, top = places[k] if places else (0, 0)
        flags = (disposals[k] if disposals else 0) << 2 | (transparent is not None)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", flags, (delays[k] if delays else 0) // 10, transparent or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<4HB", left, top, w, h, 0x40 if interlace else 0) + bytes([bits]))
        if interlace:
            f = np.concatenate([f[s::d] for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
        codes = lzw_codes(f.astype(np.uint8).tobytes(), bits, False)
        out += [bytes([len(codes[a : a + 255])]) + codes[a : a + 255] for a in range(0, len(codes), 255)] + [b"\0"]
    return b"".join(out) + b"\x3b"


def tiff(pages: list[np.ndarray], *, order: str = "<", compression: int = 1, predictor: int = 1, rows: int | None = None, orientation: int = 1) -> bytes:
    """RGBA pages of 8 bits in strips, with unassociated alpha."""
    from pixelloom.sources.codecs import tiff as t

    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for rgba in pages:
        h, w = rgba.shape[:2]
        per, offsets, sizes = rows or h, [], []
        for y in range(0, h, per):
            part = rgba[y : y + per]
            if predictor == 2:
                part = np.diff(part.astype(np.int64), axis=1, prepend=np.zeros((len(part), 1, 4), np.int64)).astype(np.uint8)
            raw = part.astype(np.uint8).tobytes()
            if compression == t.DEFLATE:
                raw = zlib.compress(raw)
            elif compression == t.PACKBITS:
                raw = b"".join(bytes([len(raw[a : a + 128]) - 1]) + raw[a : a + 128] for a in range(0, len(raw), 128))
            elif compression == t.LZW:
                raw = lzw_codes(raw, 8, True)
            offsets.append(len(out))
            sizes.append(len(raw))
            out += raw + b"\0" * (len(raw) % 2)
        entries = [
            (t.WIDTH, "I", [w]), (t.HEIGHT, "I", [h]), (t.BITS, "H", [8] * 4), (t.COMPRESSION, "H", [compression]), (t.PHOTOMETRIC, "H", [2]),
            (t.STRIPS, "I", offsets), (t.ORIENTATION, "H", [orientation]), (t.SAMPLES, "H", [4]), (t.STRIP_ROWS, "I", [per]),
            (t.STRIP_SIZES, "I", sizes), (t.PREDICTOR, "H", [predictor]), (t.EXTRA, "H", [2]),
        ]
        table = []
        for tag, code, values in entries:
            raw = struct.pack(f"{order}{len(values)}{code}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw
                raw = struct.pack(order + "I", at)
            table.append(struct.pack(order + "HHI", tag, 3 if code == "H" else 4, len(values)) + raw.ljust(4, b"\0"))
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(table)) + b"".join(table)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def bmp_runs(index: np.ndarray, palette: np.ndarray, bits: int) -> bytes:
    """Indexed pixels in runs of 8 or 4 bits (RLE8, RLE4), rows from below, a line end after each."""
    h, w = index.shape
    body = bytearray()
    for row in index[::-1].tolist():
        k = 0
        while k < w:
            n = 1
            while k + n < w and n < 255 and row[k + n] == row[k]:
                n += 1
            body += bytes([n, row[k] if bits == 8 else row[k] * 17])
            k += n
        body += b"\0\0"
    body += b"\0\1"
    table = b"".join(bytes([b, g, r, 0]) for r, g, b in palette.tolist())
    at = 54 + len(table)
    dib = struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 1 if bits == 8 else 2, len(body), 0, 0, len(palette), 0)
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + dib + table + bytes(body)


def tga_mapped(index: np.ndarray, palette: np.ndarray, flags: int = 0x20) -> bytes:
    """Indexed pixels with a colour map of 24 bits; ``flags`` say which corner comes first."""
    h, w = index.shape
    head = struct.pack("<BBBHHBHHHHBB", 0, 1, 1, 0, len(palette), 24, 0, 0, w, h, 8, flags)
    rows = index if flags & 0x20 else index[::-1]
    rows = rows[:, ::-1] if flags & 0x10 else rows
    return head + palette[:, ::-1].astype(np.uint8).tobytes() + rows.astype(np.uint8).tobytes()


def tiff_parts(rgb: np.ndarray, *, tile: int = 0, planar: bool = False) -> bytes:
    """RGB of 8 bits in tiles, or else in strips of a few rows; planes apart if asked for."""
    h, w = rgb.shape[:2]
    planes = [rgb[..., k : k + 1] for k in range(3)] if planar else [rgb]
    parts = []
    for p in planes:
        if tile:
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    cell = np.zeros((tile, tile, p.shape[2]), np.uint8)
                    cut = p[y : y + tile, x : x + tile]
                    cell[: cut.shape[0], : cut.shape[1]] = cut
                    parts.append(cell.tobytes())
        else:
            parts += [p[y : y + 7].tobytes() for y in range(0, h, 7)]
    out = bytearray(b"II" + struct.pack("<HI", 42, 0))
    offsets = []
    for raw in parts:
        offsets.append(len(out))
        out += raw + b"\0" * (len(raw) % 2)
    sizes = [len(raw) for raw in parts]
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [8] * 3), (259, 3, [1]), (262, 3, [2]), (277, 3, [3]), (284, 3, [2 if planar else 1])]
    entries += [(322, 4, [tile]), (323, 4, [tile]), (324, 4, offsets), (325, 4, sizes)] if tile else [(273, 4, offsets), (278, 4, [7]), (279, 4, sizes)]
    table = b""
    for tag, kind, values in sorted(entries):
        raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            at = len(out)
            out += raw + b"\0" * (len(raw) % 2)
            raw = struct.pack("<I", at)
        table += struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    out[4:8] = struct.pack("<I", len(out))
    return bytes(out) + struct.pack("<H", len(entries)) + table + b"\0" * 4


def jpeg_flat(gray: np.ndarray, *, progressive: bool = False, restart: int = 0) -> bytes:
    """A block of 8 x 8 for every value, exactly; Huffman tables are left out, so the standard's apply."""
    h, w = gray.shape
    out = b"\xff\xd8\xff\xdb" + struct.pack(">H", 67) + b"\0" + b"\x08" * 64
    out += bytes([0xFF, 0xC2 if progressive else 0xC0]) + struct.pack(">HBHHB", 11, 8, 8 * h, 8 * w, 1) + bytes([1, 0x11, 0])
    if restart:
        out += b"\xff\xdd" + struct.pack(">HH", 4, restart)
    out += b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 0 if progressive else 63, 0])
    # Codes of the standard's first table for sizes 0 to 8.
    codes = ("00", "010", "011", "100", "101", "110", "1110", "11110", "111110", "1111110")
    bits, before, marks = "", 0, 0

    def flushed() -> bytes:
        raw = bits + "1" * (-len(bits) % 8)
        return bytes(int(raw[k : k + 8], 2) for k in range(0, len(raw), 8)).replace(b"\xff", b"\xff\0")

    for k, v in enumerate(gray.reshape(-1).astype(int).tolist()):
        if restart and k and k % restart == 0:
            out += flushed() + bytes([0xFF, 0xD0 + marks % 8])
            bits, before, marks = "", 0, marks + 1
        # A DC of 8 (v - 128) over a divisor of 8.
        step = v - 128 - before
        before = v - 128
        size = abs(step).bit_length()
        bits += codes[size] + (format(step if step > 0 else step + (1 << size) - 1, f"0{size}b") if size else "")
        bits += "" if progressive else "1010"
    return out + flushed() + b"\xff\xd9"


def webp_lossless(rgba: np.ndarray, *, less_green: bool = False) -> bytes:
    """Literal pixels under codes of eight bits, after the green channel is taken off if asked for."""
    from pixelloom.sources.codecs.webp import LENGTH_ORDER

    h, w = rgba.shape[:2]
    bits: list[int] = []

    def put(v: int, n: int) -> None:
        bits.extend(v >> k & 1 for k in range(n))

    def lengths(size: int) -> None:
        put(0, 1)
        put(15, 4)
        for k in LENGTH_ORDER:
            put(4 if k < 16 else 0, 3)
        put(0, 1)
        for k in range(size):
            n = 8 if k < 256 else 0
            bits.extend(n >> j & 1 for j in reversed(range(4)))

    put(w - 1, 14)
    put(h - 1, 14)
    put(1, 1)
    put(0, 3)
    if less_green:
        put(1, 1)
        put(2, 2)
    put(0, 3)  # no more transforms, no cache, one group of codes
    for size in (280, 256, 256, 256):
        lengths(size)
    put(0b101, 3)  # a single distance symbol, in eight bits
    put(0, 8)
    px = rgba.astype(int)
    if less_green:
        px[..., 0], px[..., 2] = (px[..., 0] - px[..., 1]) & 255, (px[..., 2] - px[..., 1]) & 255
    for r, g, b, a in px.reshape(-1, 4).tolist():
        for v in (g, r, b, a):
            bits.extend(v >> k & 1 for k in reversed(range(8)))
    body = b"\x2f" + np.packbits(bits + [0] * (-len(bits) % 8), bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk


def zlib_static(data: bytes) -> bytes:
    """A zlib stream of one block of literals in the fixed code."""
    # Header: last block, fixed codes.
    codes = [format(0x30 + v, "08b") if v < 144 else format(0x190 + v - 144, "09b") for v in range(256)]
    bits = "110" + "".join(codes[v] for v in data) + "0000000"
    raw = np.packbits(np.frombuffer(bits.encode(), np.uint8) - 48, bitorder="little").tobytes()
    return b"\x78\x01" + raw + struct.pack(">I", zlib.adler32(data))
