"""Decoders of single images: bytes in, an RGBA array out, ``ImageError`` for what can't be read."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


class ImageError(ValueError):
    """A file that can't be decoded; the text becomes the row's error."""


@dataclass
class Image:
    """Straight RGBA of 8 bits, (h, w, 4); no pixels for files that hold none."""

    rgba: np.ndarray | None
    width: int
    height: int
    hotspot: tuple[int, int] = (0, 0)


@dataclass
class Animation:
    """Frames composed to the whole canvas, with delays in milliseconds. ``loops`` 0 is for ever."""

    frames: list[np.ndarray] = field(default_factory=list)
    delays: list[int] = field(default_factory=list)
    user_input: list[int] = field(default_factory=list)
    loops: int = 1


def need(condition, message: str) -> None:
    if not condition:
        raise ImageError(message)


def opaque(rgb: np.ndarray) -> np.ndarray:
    """(h, w, 3) with a full alpha channel."""
    return np.dstack([rgb, np.full(rgb.shape[:2], 255, np.uint8)]).astype(np.uint8)


def image(rgba: np.ndarray, hotspot: tuple[int, int] = (0, 0)) -> Image:
    return Image(np.ascontiguousarray(rgba, np.uint8), rgba.shape[1], rgba.shape[0], hotspot)


def scaled(v: np.ndarray, bits: int) -> np.ndarray:
    """Unsigned samples of ``bits`` bits to 8, rounded."""
    most = (1 << bits) - 1
    return ((v.astype(np.uint64) * 255 + most // 2) // most).astype(np.uint8)


def unpacked(rows: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits from packed rows (h, bytes), most significant first."""
    if depth == 8:
        return rows[:, :width]
    bits = np.unpackbits(rows, axis=1)[:, : width * depth].reshape(len(rows), width, depth)
    return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
