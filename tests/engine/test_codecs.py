from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from pixelloom.sources.codecs import ImageError, bmp, gif, ico, png, tga, tiff, write

RNG = np.random.default_rng(7)


def random_image(h=9, w=13):
    px = RNG.integers(0, 256, (h, w, 4), dtype=np.uint8)
    px[0, 0] = (200, 100, 50, 10)  # not premultiplied
    return px


@pytest.mark.parametrize("make, decode", [
    (write.bmp32, bmp.decode), (write.tga32, tga.decode), (lambda p: write.tga32(p, True), tga.decode), (write.png, png.decode),
    (lambda p: write.png(p, interlace=True), png.decode), (lambda p: write.ico([p]), ico.decode), (lambda p: write.tiff([p], rows=4), tiff.decode),
    (lambda p: write.tiff([p], compression=5), tiff.decode), (lambda p: write.tiff([p], compression=8, predictor=2, order=">"), tiff.decode),
    (lambda p: write.tiff([p], compression=32773), tiff.decode),
])
@pytest.mark.parametrize("size", [(1, 1), (9, 13), (40, 3)])
def test_round_trips(make, decode, size):
    px = random_image(*size)
    got = decode(make(px))
    assert (got.height, got.width) == size
    assert np.array_equal(got.rgba, px)


def test_long_lzw_streams_grow_their_codes():
    px = RNG.integers(0, 256, (80, 90, 4), dtype=np.uint8)
    assert np.array_equal(tiff.decode(write.tiff([px], compression=5)).rgba, px)
    flat = np.zeros((200, 200, 4), np.uint8)
    assert np.array_equal(tiff.decode(write.tiff([flat], compression=5)).rgba, flat)
    idx = RNG.integers(0, 256, (120, 130)).astype(np.uint8)
    table = np.stack([np.arange(256)] * 3, 1)
    assert np.array_equal(gif.decode(write.gif([idx], table)).rgba[..., 0], idx)


def bmp_of(depth, kind, body, *, width, height, palette=b"", head=40, used=0, masks=b""):
    at = 14 + head + len(masks) + len(palette)
    dib = struct.pack("<IiiHHIIiiII", 40, width, height, 1, depth, kind, len(body), 0, 0, used, 0)
    return b"BM" + struct.pack("<IHHI", at + len(body), 0, 0, at) + dib + masks + palette + body


PAL = bytes([10, 20, 30, 0, 40, 50, 60, 0, 70, 80, 90, 0, 1, 2, 3, 0])


def test_bmp_depths_and_runs():
    got = bmp.decode(bmp_of(1, 0, bytes([0b01000000, 0, 0, 0]), width=3, height=1, palette=PAL[:8])).rgba
    assert got[0, :, :3].tolist() == [[30, 20, 10], [60, 50, 40], [30, 20, 10]] and (got[..., 3] == 255).all()
    got = bmp.decode(bmp_of(4, 0, bytes([0x01, 0x20, 0, 0]), width=3, height=-1, palette=PAL, used=4)).rgba
    assert got[0, :, 0].tolist() == [30, 60, 90]
    rle = bytes([2, 1, 0, 0, 0, 3, 2, 3, 0, 0, 0, 1])  # a run and a line end; three literals padded; end
    got = bmp.decode(bmp_of(8, 1, rle, width=3, height=2, palette=PAL, used=4)).rgba
    assert got[1, :, 0].tolist() == [60, 60, 30] and got[0, :, 0].tolist() == [90, 3, 30]
    got = bmp.decode(bmp_of(4, 2, bytes([3, 0x12, 0, 1]), width=3, height=1, palette=PAL, used=4)).rgba
    assert got[0, :, 0].tolist() == [60, 90, 60]
    got = bmp.decode(bmp_of(16, 0, struct.pack("<HH", 0x7C1F, 0x03E0), width=2, height=1)).rgba
    assert got[0].tolist() == [[255, 0, 255, 255], [0, 255, 0, 255]]
    masks = struct.pack("<3I", 0xF800, 0x07E0, 0x001F)
    got = bmp.decode(bmp_of(16, 3, struct.pack("<HH", 0xFFFF, 0x07E0), width=2, height=1, masks=masks)).rgba
    assert got[0].tolist() == [[255, 255, 255, 255], [0, 255, 0, 255]]
    core = b"BM" + struct.pack("<IHHI", 0, 0, 0, 26) + struct.pack("<IHHHH", 12, 1, 1, 1, 24) + bytes([1, 2, 3, 0])
    assert bmp.decode(core).rgba[0, 0].tolist() == [3, 2, 1, 255]


@pytest.mark.parametrize("data, text", [
    (b"", "file too small"), (b"XX" + b"\0" * 30, "invalid BMP signature"),
    (bmp_of(8, 0, b"", width=0, height=1, palette=PAL), "invalid data offset"),
    (bmp_of(24, 0, b"\0" * 4, width=100000, height=100000), "invalid dimensions"),
    (bmp_of(24, 0, b"\0" * 4, width=4, height=4), "truncated pixel data"),
    (bmp_of(4, 1, b"\0" * 4, width=4, height=4, palette=PAL), "invalid compression for bit depth"),
    (bmp_of(8, 1, bytes([9, 1, 0, 1]), width=4, height=4, palette=PAL, used=4), "invalid RLE stream"),
    (bmp_of(8, 1, bytes([0, 2, 9, 9, 0, 1]), width=4, height=4, palette=PAL, used=4), "RLE delta out of bounds"),
    (bmp_of(8, 0, bytes([9, 0, 0, 0]), width=1, height=1, palette=PAL, used=4), "invalid palette index"),
])
def test_bmp_errors(data, text):
    with pytest.raises(ImageError, match=text):
        bmp.decode(data)


def tga_head(kind, w, h, depth, flags=0x20, mapped=0, first=0, count=0, bits=0):
    return struct.pack("<BBBHHBHHHHBB", 0, mapped, kind, first, count, bits, 0, 0, w, h, depth, flags)


def test_tga_kinds():
    px = tga.decode(tga_head(1, 2, 1, 8, mapped=1, count=2, bits=24) + bytes([1, 2, 3, 4, 5, 6]) + bytes([1, 0])).rgba
    assert px[0].tolist() == [[6, 5, 4, 255], [3, 2, 1, 255]]
    assert tga.decode(tga_head(3, 1, 1, 16) + b"\xff\x7f").rgba[0, 0].tolist() == [127, 127, 127, 255]
    assert tga.decode(tga_head(2, 1, 1, 15) + b"\x1f\x00").rgba[0, 0].tolist() == [0, 0, 255, 255]
    assert tga.decode(tga_head(2, 1, 1, 16) + b"\xe0\x07").rgba[0, 0].tolist() == [0, 255, 0, 255]
    assert tga.decode(tga_head(2, 1, 1, 16, 0x21) + b"\x1f\x80").rgba[0, 0].tolist() == [0, 0, 255, 255]
    corners = bytes(range(4))
    for flags, want in ((0x20, [[0, 1], [2, 3]]), (0x00, [[2, 3], [0, 1]]), (0x30, [[1, 0], [3, 2]]), (0x10, [[3, 2], [1, 0]])):
        assert tga.decode(tga_head(3, 2, 2, 8, flags) + corners).rgba[..., 0].tolist() == want
    assert tga.decode(tga_head(0, 0, 0, 0)).rgba is None


def test_tga_version_2():
    area = bytearray(495)
    area[:2] = struct.pack("<H", 495)
    area[2:8] = b"Author"
    struct.pack_into("<2H", area, 478, 22, 10)
    area[494] = 3
    body = tga_head(3, 1, 1, 8) + bytes([128])
    thumb = bytes([1, 1, 5, 6, 7])
    struct.pack_into("<I", area, 486, len(body))
    data = body + thumb + bytes(area) + struct.pack("<2I", len(body) + len(thumb), 0) + tga.FOOTER
    assert tga.extension(data)["author"] == "Author"
    assert tga.decode(data).rgba[0, 0, 0] == int((128 / 255) ** (10 / 22) * 255 + 0.5)
    assert tga.decode(data, corrections=False).rgba[0, 0, 0] == 128
    assert tga.thumbnail(data).rgba[0, 0].tolist() == [7, 6, 5, 255]


@pytest.mark.parametrize("data, text", [
    (b"\0" * 5, "file too small"), (tga_head(5, 1, 1, 8), "unsupported TGA image type"), (tga_head(2, 0, 1, 24), "invalid dimensions"),
    (tga_head(2, 2, 2, 24) + b"\0" * 5, "truncated pixel data"), (tga_head(10, 1, 1, 24) + bytes([0x85, 1, 2, 3]), "RLE packet overflow"),
    (tga_head(1, 1, 1, 8), "missing color map"), (tga_head(3, 1, 1, 24), "invalid pixel depth"),
    (tga_head(1, 1, 1, 8, mapped=1, count=1, bits=24) + b"\0\0\0\5", "color map index out of range"),
])
def test_tga_errors(data, text):
    with pytest.raises(ImageError, match=text):
        tga.decode(data)


def png_of(w, h, depth, color, raw, extra=b""):
    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + b"\0\0\0\0"

    return png.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_png_depths():
    assert png.decode(png_of(8, 1, 1, 0, b"\0\xa5")).rgba[0, :, 0].tolist() == [255, 0, 255, 0, 0, 255, 0, 255]
    assert png.decode(png_of(4, 1, 2, 0, b"\0\x1b")).rgba[0, :, 0].tolist() == [0, 85, 170, 255]
    assert png.decode(png_of(2, 1, 4, 0, b"\0\x0f")).rgba[0, :, 0].tolist() == [0, 255]
    assert png.decode(png_of(1, 1, 16, 0, b"\0\x80\x00")).rgba[0, 0].tolist() == [128, 128, 128, 255]
    assert png.decode(png_of(1, 1, 16, 6, b"\0" + b"\xff\xff" * 4)).rgba[0, 0].tolist() == [255] * 4
    assert png.decode(png_of(1, 1, 8, 4, b"\0\x07\x09")).rgba[0, 0].tolist() == [7, 7, 7, 9]
    table = bytes(v for k in range(256) for v in (k, 255 - k, 7))
    extra = struct.pack(">I", 768) + b"PLTE" + table + b"\0" * 4 + struct.pack(">I", 2) + b"tRNS" + bytes([9, 8]) + b"\0" * 4
    got = png.decode(png_of(3, 1, 8, 3, b"\0\x00\x01\xff", extra)).rgba
    assert got[0].tolist() == [[0, 255, 7, 9], [1, 254, 7, 8], [255, 0, 7, 255]]


@pytest.mark.parametrize("data, text", [
    (b"nope", "invalid PNG signature"), (png_of(0, 1, 8, 0, b"\0"), "invalid dimensions"), (png_of(1, 1, 3, 0, b"\0\0"), "unsupported PNG"),
    (png_of(2, 2, 8, 0, b"\0\1"), "truncated PNG data"), (png_of(1, 1, 8, 0, b"\0\1\2"), "unexpected PNG data size"),
    (png_of(1, 1, 8, 3, b"\0\1"), "missing PLTE"), (png_of(1, 1, 8, 0, b"\7\1"), "invalid PNG filter"),
])
def test_png_errors(data, text):
    with pytest.raises(ImageError, match=text):
        png.decode(data)


def test_gif_disposals():
    table = np.array([[0, 0, 0], [10, 0, 0], [20, 0, 0], [30, 0, 0]])
    full, one = np.full((2, 2), 1, np.uint8), np.full((1, 1), 2, np.uint8)
    for disposal, after in ((1, 20), (2, 0), (3, 10)):
        data = write.gif([full, one, np.full((1, 1), 3, np.uint8)], table, disposals=[1, disposal, 0], places=[(0, 0), (0, 0), (1, 1)], delays=[10, 20, 30])
        a = gif.animation(data)
        assert [f[0, 0, 0] for f in a.frames] == [10, 20, after]
        assert a.frames[2][1, 1, 0] == 30 and a.delays == [10, 20, 30] and a.loops == 1
    assert gif.animation(write.gif([full], table, loops=0)).loops == 0


def test_gif_background_and_rows():
    table = np.stack([np.arange(256)] * 3, 1)
    clear = gif.decode(write.gif([np.zeros((2, 2), np.uint8)], table, transparent=0)).rgba
    assert clear.reshape(-1, 4).tolist() == [[255, 255, 255, 0]] * 4  # a full table leaves the background clear
    rows = np.repeat(np.arange(21, dtype=np.uint8)[:, None], 2, 1)
    assert np.array_equal(gif.decode(write.gif([rows], table, interlace=True)).rgba[..., 0], rows)
    with pytest.raises(ImageError, match="invalid GIF signature"):
        gif.decode(b"GIF90a" + b"\0" * 20)


def test_icons():
    px = random_image(16, 16)
    assert np.array_equal(ico.decode(write.ico([random_image(4, 4), px]), 1).rgba, px)
    assert ico.decode(write.ico([px], True, (3, 5))).hotspot == (3, 5)
    with pytest.raises(ImageError, match="page index out of range"):
        ico.decode(write.ico([px]), 2)
    for data, text in ((b"\0\0\1\0\0\0", "invalid icon count"), (b"\0\0\3\0\1\0", "invalid ICO header"), (write.ico([px])[:30], "invalid icon data offset")):
        with pytest.raises(ImageError, match=text):
            ico.decode(data)
    inside = write.png(px)
    head = struct.pack("<3H4B2H2I", 0, 1, 1, 16, 16, 0, 0, 1, 32, len(inside), 22)
    assert np.array_equal(ico.decode(head + inside).rgba, px)


def test_tiff_pages_orientation_and_order():
    px = random_image(3, 5)
    data = write.tiff([px, px[::-1]], order=">")
    assert len(tiff.pages(data)[1]) == 2
    assert np.array_equal(tiff.decode(data, 1).rgba, px[::-1])
    want = {1: px, 2: px[:, ::-1], 3: px[::-1, ::-1], 4: px[::-1], 5: px.transpose(1, 0, 2), 6: np.rot90(px, -1), 7: px[::-1, ::-1].transpose(1, 0, 2), 8: np.rot90(px)}
    for way, rgba in want.items():
        assert np.array_equal(tiff.decode(write.tiff([px], orientation=way)).rgba, rgba), way
    with pytest.raises(ImageError):
        tiff.decode(data[:40])
