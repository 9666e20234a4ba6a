"""Normal forms that every source, operator and sink agrees on."""

from __future__ import annotations

#: One decoded image. ``error`` is set, and ``rgba`` null, where a file can't be decoded.
IMAGES = (
    "path string, page int, format string, width int, height int, rgba binary, "
    "hotspot_x int, hotspot_y int, error string"
)
#: One row per pixel, straight (unpremultiplied) RGBA of 8 bits in integers.
PIXELS = "img long, y int, x int, r int, g int, b int, a int"
#: One frame of an animation, composed to the full canvas.
FRAMES = (
    "path string, frame_no int, delay_ms long, user_input int, loop_count long, frame_count int, "
    "width int, height int, rgba binary, error string"
)
CHANNELS = ("r", "g", "b", "a")
