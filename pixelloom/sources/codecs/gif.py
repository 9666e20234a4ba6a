"""GIF: the first frame, or all frames composed with their disposals and delays."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from pixelloom.sources.codecs import Animation, Image, image, need


@dataclass
class Frame:
    left: int
    top: int
    indices: np.ndarray
    palette: np.ndarray
    transparent: int | None
    disposal: int
    delay_ms: int
    user_input: int


def sub_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        need(at < len(data), "truncated GIF data")
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        need(at + n <= len(data), "truncated GIF data")
        parts.append(data[at : at + n])
        at += n


def lzw(data: bytes, bits: int, pixels: int) -> np.ndarray:
    """Codes, least significant bit first; a clear code starts a new table, which is full at 4096 entries."""
    need(2 <= bits <= 8, "invalid LZW code size")
    clear, stop = 1 << bits, (1 << bits) + 1
    base = [bytes([k]) for k in range(clear)] + [b"", b""]
    table, width, before = list(base), bits + 1, None
    out, size, store, have = [], 0, 0, 0
    for byte in data:
        store |= byte << have
        have += 8
        while have >= width:
            code = store & (1 << width) - 1
            store >>= width
            have -= width
            if code == clear:
                table, width, before = list(base), bits + 1, None
                continue
            if code == stop or size >= pixels:
                have = -(1 << 30)
                break
            if before is None:
                need(code < clear, "invalid LZW code")
                entry = table[code]
            else:
                need(code <= len(table), "invalid LZW code")
                entry = table[code] if code < len(table) else before + before[:1]
                if len(table) < 4096:
                    table.append(before + entry[:1])
                    if len(table) == 1 << width and width < 12:
                        width += 1
            out.append(entry)
            size += len(entry)
            before = entry
        if have < 0:
            break
    need(size >= pixels, "LZW data too short")
    return np.frombuffer(b"".join(out), np.uint8)[:pixels]


def deinterlace(rows: np.ndarray) -> np.ndarray:
    order = np.concatenate([np.arange(start, len(rows), step) for start, step in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def header(data: bytes) -> tuple[int, int, np.ndarray | None, tuple[int, int, int, int], int]:
    need(len(data) >= 13 and data[:6] in (b"GIF87a", b"GIF89a"), "invalid GIF signature")
    width, height, flags, background = struct.unpack_from("<HHBB", data, 6)
    need(width and height, "invalid dimensions")
    table, at = None, 13
    fill = (255, 255, 255, 0)
    if flags & 128:
        n = 2 << (flags & 7)
        need(at + 3 * n <= len(data), "truncated GIF color table")
        table = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
        # The table's size is compared as a byte, so a full table of 256 leaves the background clear.
        if background < n % 256:
            fill = (*table[background].tolist(), 255)
    return width, height, table, fill, at


def frames(data: bytes, at: int, width: int, height: int, shared: np.ndarray | None, loops: list[int]) -> Iterator[Frame]:
    disposal, delay, user, transparent = 0, 0, 0, None
    while True:
        need(at < len(data), "truncated GIF data")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            need(at < len(data), "truncated GIF data")
            label = data[at]
            body, at = sub_blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                disposal, user = body[0] >> 2 & 7, body[0] >> 1 & 1
                delay = (body[1] | body[2] << 8) * 10
                transparent = body[3] if body[0] & 1 else None
            elif label == 0xFF and body[:11] in (b"NETSCAPE2.0", b"ANIMEXTS1.0") and len(body) >= 14 and body[11] == 1:
                loops[0] = body[12] | body[13] << 8
            continue
        need(kind == 0x2C, "invalid GIF block")
        need(at + 9 <= len(data), "truncated GIF data")
        left, top, w, h, flags = struct.unpack_from("<4HB", data, at)
        at += 9
        need(w and h and left + w <= width and top + h <= height, "invalid GIF frame")
        palette = shared
        if flags & 128:
            n = 2 << (flags & 7)
            need(at + 3 * n <= len(data), "truncated GIF color table")
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        need(palette is not None, "missing GIF color table")
        need(at < len(data), "truncated GIF data")
        bits = data[at]
        packed, at = sub_blocks(data, at + 1)
        indices = lzw(packed, bits, w * h).reshape(h, w)
        yield Frame(left, top, deinterlace(indices) if flags & 64 else indices, palette, transparent, disposal, delay, user)
        disposal, delay, user, transparent = 0, 0, 0, None


def draw(canvas: np.ndarray, f: Frame) -> None:
    shown = f.indices != (-1 if f.transparent is None else f.transparent)
    need(int(f.indices[shown].max(initial=0)) < len(f.palette), "invalid palette index")
    h, w = f.indices.shape
    part = canvas[f.top : f.top + h, f.left : f.left + w]
    part[shown, :3] = f.palette[f.indices[shown]]
    part[shown, 3] = 255


def canvas_of(width: int, height: int, fill) -> np.ndarray:
    return np.broadcast_to(np.array(fill, np.uint8), (height, width, 4)).copy()


def decode(data: bytes) -> Image:
    """The canvas in its background colour with the first frame on it."""
    width, height, table, fill, at = header(data)
    canvas = canvas_of(width, height, fill)
    first = next(frames(data, at, width, height, table, [1]), None)
    need(first is not None, "no GIF frames")
    draw(canvas, first)
    return image(canvas)


def animation(data: bytes) -> Animation:
    width, height, table, fill, at = header(data)
    canvas, out, loops = canvas_of(width, height, fill), Animation(), [1]
    for f in frames(data, at, width, height, table, loops):
        saved = canvas.copy() if f.disposal == 3 else None
        draw(canvas, f)
        out.frames.append(canvas.copy())
        out.delays.append(f.delay_ms)
        out.user_input.append(f.user_input)
        if f.disposal == 2:
            h, w = f.indices.shape
            canvas[f.top : f.top + h, f.left : f.left + w] = fill
        elif f.disposal == 3:
            canvas = saved
    need(out.frames, "no GIF frames")
    out.loops = loops[0]
    return out
