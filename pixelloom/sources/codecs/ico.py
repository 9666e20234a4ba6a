"""ICO and CUR: the directory as records, pages as bitmaps with masks or as PNG."""

from __future__ import annotations

import struct
from typing import NamedTuple

import numpy as np

from pixelloom.sources.codecs import Image, image, need, png, unpacked


class Entry(NamedTuple):
    width: int
    height: int
    colors: int
    planes: int
    bitcount: int
    size: int
    offset: int


def directory(data: bytes) -> tuple[list[Entry], bool]:
    """Entries, and whether the file holds cursors."""
    need(len(data) >= 6, "file too small")
    zero, kind, count = struct.unpack_from("<3H", data)
    need(zero == 0 and kind in (1, 2), "invalid ICO header")
    need(0 < count <= 256, "invalid icon count")
    need(6 + 16 * count <= len(data), "truncated icon directory")
    entries = []
    for k in range(count):
        w, h, colors, _, planes, bits, size, offset = struct.unpack_from("<4B2H2I", data, 6 + 16 * k)
        need(size and offset + size <= len(data) and offset >= 6 + 16 * count, "invalid icon data offset")
        entries.append(Entry(w or 256, h or 256, colors, planes, bits, size, offset))
    return entries, kind == 2


def decode(data: bytes, page: int = 0) -> Image:
    entries, cursor = directory(data)
    need(0 <= page < len(entries), "page index out of range")
    e = entries[page]
    body = data[e.offset : e.offset + e.size]
    found = png.decode(body) if body[:8] == png.SIGNATURE else bitmap(body, e)
    if cursor:
        found.hotspot = (e.planes, e.bitcount)
    return found


def bitmap(body: bytes, e: Entry) -> Image:
    """A headless BMP of twice the height: colours over a mask of one bit."""
    need(len(body) >= 40, "invalid DIB header size")
    head, width, tall, _, depth, kind = struct.unpack_from("<IiiHHI", body)
    used = struct.unpack_from("<I", body, 32)[0]
    need(head >= 40, "invalid DIB header size")
    need(head <= len(body), "truncated icon data")
    need(width > 0 and abs(tall) >= 2, "invalid icon dimensions")
    height = abs(tall) // 2
    if kind == 5:
        at = body.find(png.SIGNATURE, head)
        need(at >= 0, "missing PNG data")
        return png.decode(body[at:])
    need(kind == 0, "unsupported DIB compression")
    need(depth in (1, 4, 8, 24, 32), "unsupported bit depth")
    at = head
    if depth <= 8:
        n = min(1 << depth, used or e.colors or 1 << depth)
        need(at + 4 * n <= len(body), "truncated icon data")
        table = np.frombuffer(body, np.uint8, 4 * n, at).reshape(n, 4)[:, 2::-1]
        at += 4 * n
    stride, mask_stride = (width * depth + 31) // 32 * 4, (width + 31) // 32 * 4
    need(at + stride * height <= len(body), "truncated icon data")
    rows = np.frombuffer(body, np.uint8, stride * height, at).reshape(height, stride)
    at += stride * height
    alpha = np.full((height, width), 255, np.uint8)
    if depth <= 8:
        indices = unpacked(rows, depth, width)
        need(int(indices.max()) < len(table), "invalid palette index")
        rgb = table[indices]
    else:
        px = rows[:, : width * depth // 8].reshape(height, width, depth // 8)
        rgb = px[..., 2::-1]
        if depth == 32:
            alpha = px[..., 3].copy()
    if at + mask_stride * height <= len(body) and (depth != 32 or (alpha == 255).all()):
        mask = unpacked(np.frombuffer(body, np.uint8, mask_stride * height, at).reshape(height, mask_stride), 1, width)
        alpha[mask == 1] = 0
    rgba = np.dstack([rgb, alpha])
    return image(rgba if tall < 0 else rgba[::-1])
