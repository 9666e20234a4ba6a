"""PNG: every colour type and depth, Adam7. Checksums are not verified."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from pixelloom.sources.codecs import Image, image, need, opaque, scaled, unpacked

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
#: Adam7 passes as (first column, first row, column step, row step), fixed values.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def inflate(data: bytes) -> bytes:
    """A zlib stream's content without its checksum."""
    need(len(data) >= 2 and data[0] & 15 == 8 and (data[0] * 256 + data[1]) % 31 == 0 and not data[1] & 32, "zlib decompression failed")
    try:
        return zlib.decompressobj(-15).decompress(data[2:])
    except zlib.error:
        need(False, "zlib decompression failed")


def unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Scanlines (h, 1 + bytes) to bytes. Runs of whole-row filters are array sums; the others walk the row."""
    kinds, rows = raw[:, 0], raw[:, 1:]
    out = np.zeros(rows.shape, np.uint8)
    above = np.zeros(rows.shape[1], np.uint8)
    for y, kind in enumerate(kinds.tolist()):
        row = rows[y]
        need(kind <= 4, "invalid PNG filter")
        if kind == 1:
            pad = -len(row) % step
            row = np.add.accumulate(np.pad(row, (0, pad)).reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[: len(row)]
        elif kind == 2:
            row = row + above
        elif kind:
            row = walked(row, above, step, kind)
        out[y] = above = row
    return out


def walked(row: np.ndarray, above: np.ndarray, step: int, kind: int) -> np.ndarray:
    src, up = row.tolist(), above.tolist()
    done = [0] * step
    up = [0] * step + up
    for k, v in enumerate(src):
        a, b, c = done[k], up[k + step], up[k]
        if kind == 3:
            guess = (a + b) >> 1
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        done.append((v + guess) & 255)
    return np.array(done[step:], np.uint8)


def chunks(data: bytes):
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        need(at + 12 + size <= len(data), "truncated PNG chunk")
        yield kind, data[at + 8 : at + 8 + size]
        at += 12 + size


def decode(data: bytes) -> Image:
    need(len(data) >= 8 and data[:4] == SIGNATURE[:4], "invalid PNG signature")
    head = palette = alpha = None
    parts = []
    for kind, body in chunks(data):
        if kind == b"IHDR":
            need(len(body) == 13, "invalid IHDR")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            need(len(body) and len(body) % 3 == 0 and len(body) <= 768, "invalid PLTE")
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            alpha = np.frombuffer(body, np.uint8)
        elif kind == b"IDAT":
            parts.append(body)
        elif kind == b"IEND":
            break
    need(head, "missing IHDR")
    need(parts, "missing IDAT")
    width, height, depth, color, method, filtering, interlace = head
    need(width and height, "invalid dimensions")
    need(color in DEPTHS and depth in DEPTHS[color], "unsupported PNG color type or bit depth")
    need(not method and not filtering and interlace <= 1, "unsupported PNG method")
    need(color != 3 or palette is not None, "missing PLTE")
    raw = np.frombuffer(inflate(b"".join(parts)), np.uint8)
    n = CHANNELS[color]
    step = max(1, n * depth // 8)
    samples = np.zeros((height, width, n), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x0, y0, dx, dy in PASSES if interlace else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        size = (w * n * depth + 7) // 8
        need(at + h * (size + 1) <= len(raw), "truncated PNG data")
        rows = unfilter(raw[at : at + h * (size + 1)].reshape(h, size + 1), step)
        at += h * (size + 1)
        if depth == 16:
            part = np.ascontiguousarray(rows).view(">u2").reshape(h, w, n)
        else:
            part = unpacked(rows, depth, w * n).reshape(h, w, n)
        samples[y0::dy, x0::dx] = part
    need(at == len(raw), "unexpected PNG data size")
    if color == 3:
        indices = samples[..., 0]
        need(int(indices.max()) < len(palette), "invalid palette index")
        table = np.full((len(palette), 4), 255, np.uint8)
        table[:, :3] = palette
        if alpha is not None:
            table[: min(len(alpha), len(table)), 3] = alpha[: len(table)]
        return image(table[indices])
    if depth == 16:
        eight = ((samples.astype(np.uint32) + 128) // 257).astype(np.uint8)
    else:
        eight = scaled(samples, depth) if depth < 8 else samples
    if color in (0, 4):
        rgb = np.repeat(eight[..., :1], 3, axis=2)
        return image(opaque(rgb) if color == 0 else np.dstack([rgb, eight[..., 1]]))
    return image(opaque(eight) if color == 2 else eight)
