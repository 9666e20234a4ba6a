"""BMP: headers of 12 to 124 bytes, depths 1 to 32, run lengths, bit fields, embedded PNG and JPEG."""

from __future__ import annotations

import struct

import numpy as np

from pixelloom.sources.codecs import Image, image, need, opaque, scaled, unpacked

RGB, RLE8, RLE4, BITFIELDS, JPEG, PNG, ALPHABITFIELDS = range(7)
MOST = 65535
HEADERS = (12, 40, 52, 56, 108, 124)
#: Rendering intent that marks premultiplied colour, a fixed value.
IMAGES_INTENT = 4


def field(pixels: np.ndarray, mask: int) -> np.ndarray:
    """A bit field scaled to 8 bits."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    shift = (mask & -mask).bit_length() - 1
    bits = bin(mask >> shift).count("1")
    v = (pixels & np.uint32(mask)) >> np.uint32(shift)
    return (v >> np.uint32(bits - 8)).astype(np.uint8) if bits >= 8 else scaled(v, bits)


def straight(rgba: np.ndarray, declared: bool) -> np.ndarray:
    """Undo premultiplication where it is declared or no channel exceeds alpha."""
    a = rgba[..., 3].astype(np.int64)
    if not (a < 255).any() or not (declared or (rgba[..., :3].max(2) <= a).all()):
        return rgba
    rgb = (rgba[..., :3].astype(np.int64) * 255 + (a // 2)[..., None]) // np.maximum(a, 1)[..., None]
    return np.dstack([np.where(a[..., None] == 0, 0, rgb & 255), a]).astype(np.uint8)


def run_lengths(src: bytes, width: int, height: int, nibbles: bool) -> np.ndarray:
    """Indices by stored row; places that no run reaches stay 0."""
    out = np.zeros((height, width), np.uint8)
    pos = x = y = 0
    while y < height:
        need(pos + 1 < len(src), "truncated pixel data")
        count, value = src[pos], src[pos + 1]
        pos += 2
        if count:
            need(x + count <= width, "invalid RLE stream")
            pair = (value >> 4, value & 15) if nibbles else (value, value)
            out[y, x : x + count] = np.resize(np.array(pair, np.uint8), count)
            x += count
        elif value == 0:
            x, y = 0, y + 1
        elif value == 1:
            break
        elif value == 2:
            need(pos + 1 < len(src), "truncated pixel data")
            dx, dy = src[pos], src[pos + 1]
            pos += 2
            need(x + dx <= width and y + dy <= height, "RLE delta out of bounds")
            x, y = x + dx, y + dy
        else:
            size = (value + 1) // 2 if nibbles else value
            need(pos + size <= len(src), "truncated pixel data")
            need(x + value <= width, "invalid RLE stream")
            run = np.frombuffer(src, np.uint8, size, pos)
            if nibbles:
                run = np.stack([run >> 4, run & 15], 1).reshape(-1)[:value]
            out[y, x : x + value] = run
            x += value
            pos += size
            if size & 1:
                need(pos < len(src), "truncated pixel data")
                pos += 1
    return out


def decode(data: bytes) -> Image:
    need(len(data) >= 18, "file too small")
    need(data[:2] == b"BM", "invalid BMP signature")
    size, at, head = struct.unpack_from("<I4xII", data, 2)
    need(not size or 14 <= size <= len(data), "file too small")
    data = data[:size] if size else data
    need(at < len(data), "invalid data offset")
    need(head in HEADERS, "unknown header version")
    need(14 + head <= len(data), "file too small")
    kind, used, masks, top_down, declared = RGB, 0, None, False, False
    if head == 12:
        width, height, planes, depth = struct.unpack_from("<4H", data, 18)
    else:
        width, height, planes, depth, kind = struct.unpack_from("<iiHHI", data, 18)
        used = struct.unpack_from("<I", data, 46)[0]
        need(width > 0 and height not in (0, -(1 << 31)), "invalid dimensions")
        top_down, height = height < 0, abs(height)
        if head >= 52:
            masks = [*struct.unpack_from("<3I", data, 54), struct.unpack_from("<I", data, 66)[0] if head >= 56 else 0]
        if head >= 108:
            intent = struct.unpack_from("<I", data, 122)[0] if head >= 124 else None
            declared = IMAGES_INTENT in (struct.unpack_from("<I", data, 70)[0], intent)
    need(0 < width <= MOST and 0 < height <= MOST, "invalid dimensions")
    need(planes == 1, "invalid BMP header")
    need(depth in (1, 4, 8, 16, 24, 32), "unsupported bit depth")
    allowed = {RLE8: (8,), RLE4: (4,), BITFIELDS: (16, 32), ALPHABITFIELDS: (16, 32)}
    need(kind <= ALPHABITFIELDS and depth in allowed.get(kind, (depth,)), "invalid compression for bit depth")
    table = 14 + head
    if kind in (BITFIELDS, ALPHABITFIELDS) and head == 40:
        n = 4 if kind == ALPHABITFIELDS else 3
        need(table + 4 * n <= len(data), "file too small")
        need(table + 4 * n <= at, "invalid data offset")
        masks = [*struct.unpack_from(f"<{n}I", data, table), 0][:4]
        table += 4 * n
    if kind in (JPEG, PNG):
        from pixelloom.sources.codecs import jpeg, png

        return (jpeg if kind == JPEG else png).decode(data[at:])
    if depth <= 8:
        indices, palette = stored_indices(data, at, kind, depth, width, height), colors(data, table, at, head, depth, used)
        need(int(indices.max()) < len(palette), "invalid palette index")
        rgba = palette[indices]
    else:
        rgba = direct(data, at, kind, depth, width, height, masks, declared)
    return image(rgba if top_down else rgba[::-1])


def colors(data: bytes, table: int, at: int, head: int, depth: int, used: int) -> np.ndarray:
    entries = used if used and head != 12 else 1 << depth
    need(entries <= 1 << depth, "palette too large")
    size = 3 if head == 12 else 4
    need(table + entries * size <= len(data), "file too small")
    need(table + entries * size <= at, "palette too large")
    raw = np.frombuffer(data, np.uint8, entries * size, table).reshape(entries, size)
    alpha = raw[:, 3] if size == 4 and (raw[:, 3].any() or head >= 108) else np.full(entries, 255, np.uint8)
    return np.column_stack([raw[:, 2::-1], alpha])


def rows_of(data: bytes, at: int, depth: int, width: int, height: int) -> np.ndarray:
    stride = (width * depth + 31) // 32 * 4
    need(at + stride * height <= len(data), "truncated pixel data")
    return np.frombuffer(data, np.uint8, stride * height, at).reshape(height, stride)


def stored_indices(data: bytes, at: int, kind: int, depth: int, width: int, height: int) -> np.ndarray:
    if kind in (RLE8, RLE4):
        return run_lengths(data[at:], width, height, kind == RLE4)
    return unpacked(rows_of(data, at, depth, width, height), depth, width)


def direct(data: bytes, at: int, kind: int, depth: int, width: int, height: int, masks, declared: bool) -> np.ndarray:
    fields = depth in (16, 32) and (kind != RGB or (masks is not None and any(masks[:3])))
    need(not fields or all(masks[:3]), "invalid compression for bit depth")
    rows = rows_of(data, at, depth, width, height)
    if depth == 24 or depth == 32 and not fields:
        px = rows[:, : width * depth // 8].reshape(height, width, depth // 8)
        return opaque(px[..., 2::-1])
    px = np.ascontiguousarray(rows[:, : width * depth // 8]).view(f"<u{depth // 8}").astype(np.uint32)
    masks = masks if fields else [0x7C00, 0x03E0, 0x001F, 0]
    alpha = field(px, masks[3]) if masks[3] else np.full(px.shape, 255, np.uint8)
    rgba = np.dstack([*(field(px, m) for m in masks[:3]), alpha])
    return straight(rgba, declared) if masks[3] else rgba
