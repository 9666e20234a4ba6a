"""TGA: types 0 to 3 and 9 to 11, colour maps, both origins, version 2 metadata and corrections."""

from __future__ import annotations

import struct

import numpy as np

from pixelloom.sources.codecs import Image, image, need, scaled

FOOTER = b"TRUEVISION-XFILE.\0"
AREA = 495


def fivebit(v: np.ndarray) -> np.ndarray:
    return np.dstack([scaled(v >> s & 31, 5) for s in (10, 5, 0)])


def run_lengths(data: bytes, at: int, pixels: int, size: int) -> bytes:
    out, done = [], 0
    while done < pixels:
        need(at < len(data), "truncated RLE data")
        head = data[at]
        at += 1
        n = (head & 127) + 1
        need(done + n <= pixels, "RLE packet overflow")
        span = size if head & 128 else size * n
        need(at + span <= len(data), "truncated RLE data")
        out.append(data[at : at + size] * n if head & 128 else data[at : at + span])
        at += span
        done += n
    return b"".join(out)


def text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1")


def extension(data: bytes) -> dict:
    """Fields of the extension area, or nothing where there is none."""
    at = 0
    if len(data) >= 26 and data[-18:] == FOOTER:
        at = struct.unpack_from("<I", data, len(data) - 26)[0]
        if not at:
            return {}
    elif len(data) >= AREA and struct.unpack_from("<H", data, len(data) - AREA)[0] == AREA:
        at = len(data) - AREA
    else:
        return {}
    need(at + AREA <= len(data), "truncated extension area")
    area = data[at : at + AREA]
    key, ratio, gamma = (struct.unpack_from(f, area, o) for f, o in (("<4B", 470), ("<2H", 474), ("<2H", 478)))
    return {
        "author": text(area[2:43]),
        "comments": text(area[43:367]),
        "timestamp": struct.unpack_from("<6H", area, 367),
        "job": text(area[379:420]),
        "software": text(area[426:467]),
        "key_color": key,
        "aspect": ratio,
        "gamma": gamma,
        "correction_offset": struct.unpack_from("<I", area, 482)[0],
        "thumbnail_offset": struct.unpack_from("<I", area, 486)[0],
        "attributes": area[494],
    }


def palette_of(data: bytes, at: int, first: int, count: int, bits: int) -> np.ndarray:
    size = (bits + 7) // 8
    need(at + count * size <= len(data), "truncated color map")
    raw = np.frombuffer(data, np.uint8, count * size, at).reshape(count, size)
    if size == 2:
        v = raw.astype(np.uint16) @ np.array([1, 256], np.uint16)
        rgb = fivebit(v[None])[0]
        alpha = np.full(count, 255, np.uint8)
    else:
        rgb, alpha = raw[:, 2::-1], raw[:, 3] if size == 4 else np.full(count, 255, np.uint8)
    out = np.zeros((first + count, 4), np.uint8)
    out[first:] = np.column_stack([rgb, alpha])
    return out


def corrected(rgba: np.ndarray, data: bytes, ext: dict, use_alpha: bool) -> np.ndarray:
    num, den = ext.get("gamma", (0, 0))
    out = rgba.copy()
    if num and den and num != den:
        lut = (np.power(np.arange(256) / 255.0, den / num) * 255.0 + 0.5).astype(np.uint8)
        out[..., :3] = lut[out[..., :3]]
    at = ext.get("correction_offset", 0)
    if at:
        need(at + 2048 <= len(data), "truncated color correction table")
        table = scaled(np.frombuffer(data, "<u2", 1024, at).reshape(256, 4), 16)
        # Stored as alpha, red, green, blue.
        for c in range(3):
            out[..., c] = table[out[..., c], c + 1]
        if use_alpha:
            out[..., 3] = table[out[..., 3], 0]
    return out


def decode(data: bytes, corrections: bool = True) -> Image:
    need(len(data) >= 18, "file too small")
    id_size, mapped, kind, first, count, bits, _, _, width, height, depth, flags = struct.unpack_from("<BBBHHBHHHHBB", data)
    need(mapped <= 1, "invalid color map type")
    base = kind - 8 if kind >= 9 else kind
    if kind:
        need(width and height, "invalid dimensions")
        need(kind <= 3 or 9 <= kind <= 11, "unsupported TGA image type")
        name, depths = {1: ("color-mapped", (8, 16)), 2: ("true-color", (15, 16, 24, 32)), 3: ("grayscale", (8, 16))}[base]
        need(mapped == (base == 1), "missing color map" if base == 1 else "unexpected color map")
        need(depth in depths, f"invalid pixel depth for {name} TGA")
        if base == 1:
            need(count, "missing color map")
            need(bits in (15, 16, 24, 32), "invalid color map entry size")
        most = {15: 0, 16: 1, 24: 0, 32: 8}[depth] if base == 2 else 0
        need(flags & 15 <= most, "invalid alpha bits")
    at = 18 + id_size
    need(at <= len(data), "truncated image ID")
    ext = extension(data)
    if not kind:
        return Image(None, 0, 0)
    palette = None
    if mapped:
        palette = palette_of(data, at, first, count, bits)
        at += count * ((bits + 7) // 8)
    size = (depth + 7) // 8
    raw = run_lengths(data, at, width * height, size) if kind >= 9 else data[at : at + width * height * size]
    need(len(raw) == width * height * size, "truncated pixel data")
    px = np.frombuffer(raw, np.uint8).reshape(height, width, size)
    use_alpha = flags & 15 > 0 and ext.get("attributes", 1) != 0
    word = px[..., 0].astype(np.uint32) | (px[..., 1].astype(np.uint32) << 8 if size >= 2 else 0)
    alpha = np.full((height, width), 255, np.uint8)
    if base == 1:
        need(int(word.max()) < len(palette), "color map index out of range")
        rgba = palette[word]
    elif base == 3:
        grey = px[..., 0] if size == 1 else scaled(word, 16)
        rgba = np.dstack([grey, grey, grey, alpha])
    elif size >= 3:
        rgba = np.dstack([px[..., 2::-1], px[..., 3] if size == 4 and use_alpha else alpha])
    elif depth == 16 and not (ext.get("attributes") if ext else flags & 15):
        # Sixteen bits without an attribute bit are read as 5-6-5.
        rgba = np.dstack([scaled(word >> 11 & 31, 5), scaled(word >> 5 & 63, 6), scaled(word & 31, 5), alpha])
    else:
        if depth == 16 and use_alpha:
            alpha = np.where(word & 0x8000, 255, 0).astype(np.uint8)
        rgba = np.dstack([fivebit(word), alpha])
    if not flags & 0x20:
        rgba = rgba[::-1]
    if flags & 0x10:
        rgba = rgba[:, ::-1]
    return image(corrected(rgba, data, ext, use_alpha) if corrections else rgba)


def thumbnail(data: bytes) -> Image | None:
    at = extension(data).get("thumbnail_offset", 0)
    if not at:
        return None
    need(at + 2 <= len(data), "truncated thumbnail")
    w, h = data[at], data[at + 1]
    need(at + 2 + w * h * 3 <= len(data), "truncated thumbnail")
    bgr = np.frombuffer(data, np.uint8, w * h * 3, at + 2).reshape(h, w, 3)
    return image(np.dstack([bgr[..., ::-1], np.full((h, w), 255, np.uint8)]))
