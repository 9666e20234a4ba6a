from __future__ import annotations

import base64

import numpy as np
import pytest

from pixelloom.sources.codecs import ImageError, svg, write


def render(body, size=(100, 80), head="", **options):
    w, h = size
    return svg.decode(f'<?xml version="1.0"?><!-- c --><svg xmlns="x" width="{w}" height="{h}" {head}>{body}</svg>'.encode(), **options).rgba


def at(px, x, y):
    return tuple(px[y, x].tolist())


RED, BLUE, NONE = (255, 0, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)


def test_shapes():
    px = render('<rect x="10" y="10" width="20" height="20" fill="red"/><circle cx="60" cy="20" r="10" fill="#00f"/><polygon points="0,79 20,79 0,59" fill="rgb(0,128,0)"/><ellipse cx="80" cy="60" rx="10" ry="5" fill="hsl(60,100%,50%)"/>')
    assert at(px, 10, 10) == RED and at(px, 29, 29) == RED and at(px, 30, 30) == NONE and at(px, 9, 15) == NONE
    assert at(px, 60, 20) == BLUE and at(px, 51, 11) == NONE and at(px, 2, 75) == (0, 128, 0, 255) and at(px, 80, 60) == (255, 255, 0, 255)
    blue = (px[..., 2] == 255) & (px[..., 3] > 128)
    assert abs(blue.sum() - np.pi * 100) < 12


def test_paths():
    px = render('<path d="M10 10h20v20h-20z m5 5v10h10v-10z" fill="red"/><path d="M50 10 q20 0 20 20 t-20 20 z" fill="blue" fill-rule="evenodd"/><path d="M10 60 a10 10 0 1 1 20 0 z"/>')
    assert at(px, 12, 12) == RED and at(px, 20, 20) == NONE
    assert at(px, 60, 20) == BLUE and px[55, 20, 3] == 255 and px[65, 20, 3] == 0
    smooth = svg.path("M0 0C0 10 10 10 10 0S20-10 20 0")
    assert len(smooth) == 1 and smooth[0][0][-1] == (20.0, 0.0) and min(y for _, y in smooth[0][0]) < -7


def test_strokes():
    px = render('<line x1="10" y1="20" x2="50" y2="20" stroke="red" stroke-width="4"/><polyline points="60,10 80,10 80,30" fill="none" stroke="blue" stroke-width="6"/>')
    assert at(px, 10, 18) == RED and at(px, 10, 21) == RED and at(px, 9, 20) == NONE and at(px, 30, 22) == NONE
    assert at(px, 82, 7) == BLUE  # the miter's corner
    bevel = render('<polyline points="60,10 80,10 80,30" fill="none" stroke="blue" stroke-width="6" stroke-linejoin="bevel"/>')
    assert at(bevel, 82, 7) == NONE
    round_ = render('<line x1="20" y1="20" x2="50" y2="20" stroke="red" stroke-width="10" stroke-linecap="round"/><line x1="20" y1="50" x2="50" y2="50" stroke="red" stroke-width="10" stroke-linecap="square"/>')
    assert at(round_, 16, 20) == RED and at(round_, 15, 15) == NONE and at(round_, 15, 45) == RED
    dash = render('<line x1="0" y1="20" x2="100" y2="20" stroke="red" stroke-width="4" stroke-dasharray="10 5"/>')
    assert at(dash, 5, 20) == RED and at(dash, 12, 20) == NONE and at(dash, 17, 20) == RED


def test_transforms_groups_and_opacity():
    px = render('<g transform="translate(50 0) scale(2)" fill="red" opacity="0.5"><rect width="10" height="10"/><rect y="10" width="10" height="10" opacity=".5"/></g><rect transform="rotate(90 20 60)" x="20" y="50" width="20" height="10" fill="blue"/>')
    assert at(px, 50, 0)[:2] == (255, 0) and px[0, 50, 3] == 128 and px[25, 60, 3] == 64 and px[0, 49, 3] == 0
    assert at(px, 25, 65) == BLUE and at(px, 15, 65) == NONE
    assert svg.transform("skewX(45) translate(1,2)") == pytest.approx((1, 0, 1, 1, 3, 2))


def test_view_boxes():
    px = render('<rect width="10" height="10" fill="red"/>', (100, 50), 'viewBox="0 0 10 10"')
    assert at(px, 25, 0) == RED and at(px, 74, 49) == RED and at(px, 24, 10) == NONE
    px = render('<rect width="10" height="10" fill="red"/>', (100, 50), 'viewBox="0 0 10 10" preserveAspectRatio="none"')
    assert at(px, 0, 0) == RED and at(px, 99, 49) == RED
    assert svg.decode(b'<svg viewBox="0 0 30 20"/>').rgba.shape == (20, 30, 4)
    assert svg.decode(b'<svg viewBox="0 0 30 20"/>', width=60, scale=2).rgba.shape == (80, 120, 4)
    assert render("", (2, 2), background=255)[0, 0].tolist() == [255] * 4


def test_styles():
    css = '<style>/* c */ rect{fill:lime} .a{fill:red} #b{fill:blue} g > rect.c{fill:#123} rect[data-k="1"]{fill:#456} rect + circle{fill:red} rect ~ line{stroke:blue}</style>'
    body = css + '<rect width="9" height="9"/><rect class="x a" x="10" width="9" height="9"/><rect id="b" class="a" x="20" width="9" height="9"/><g><rect class="c" x="30" width="9" height="9"/></g><rect class="c" x="40" width="9" height="9" fill="red"/><rect data-k="1" x="50" width="9" height="9" style="fill:#789"/><circle cx="64" cy="4" r="4"/>'
    px = render(body)
    assert [at(px, x, 4)[:3] for x in (4, 14, 24, 34, 44, 54, 64)] == [(0, 255, 0), (255, 0, 0), (0, 0, 255), (17, 34, 51), (0, 255, 0), (119, 136, 153), (255, 0, 0)]
    assert at(render('<style><![CDATA[rect{fill:red}]]></style><rect width="9" height="9"/>'), 4, 4) == RED
    assert at(render('<g display="none"><rect width="9" height="9"/></g><rect width="9" height="9" x="10" visibility="hidden"/>'), 14, 4) == NONE


def test_gradients():
    defs = '<defs><linearGradient id="g"><stop offset="0" stop-color="black"/><stop offset="100%" stop-color="white"/></linearGradient><linearGradient id="h" href="#g" gradientUnits="userSpaceOnUse" x1="0" x2="50" spreadMethod="reflect"/><radialGradient id="r"><stop offset=".5" stop-color="red"/><stop offset=".5" stop-color="blue" stop-opacity=".5"/></radialGradient></defs>'
    px = render(defs + '<rect width="100" height="20" fill="url(#g)"/><rect y="20" width="100" height="20" fill="url(#h)"/><rect y="40" x="0" width="40" height="40" fill="url(#r)"/>').astype(int)
    assert abs(px[10, 50, 0] - 128) <= 2 and px[10, 99, 0] > 250 and px[10, 0, 0] < 5
    assert abs(px[30, 25, 0] - 128) <= 3 and abs(px[30, 75, 0] - 128) <= 3 and px[30, 50, 0] > 250
    assert at(px, 20, 60) == RED and at(px, 20, 75)[2:] == (255, 128)


def test_use_symbol_and_clip():
    body = '<defs><rect id="s" width="10" height="10"/><symbol id="y" viewBox="0 0 2 2"><rect width="2" height="2" fill="blue"/></symbol><clipPath id="c"><circle cx="75" cy="20" r="10"/></clipPath></defs><use href="#s" x="10" y="5" fill="red"/><use xlink:href="#y" x="30" y="0" width="20" height="20"/><rect x="60" width="30" height="40" fill="red" clip-path="url(#c)"/>'
    px = render(body)
    assert at(px, 15, 10) == RED and at(px, 9, 10) == NONE and at(px, 49, 19) == BLUE
    assert at(px, 75, 20) == RED and at(px, 61, 1) == NONE
    loop = '<g id="a"><use href="#a"/></g>'
    assert render(loop).sum() == 0


def test_images_are_data_only(tmp_path):
    px = np.zeros((2, 2, 4), np.uint8)
    px[:] = (0, 255, 0, 255)
    uri = "data:image/png;base64," + base64.b64encode(write.png(px)).decode()
    assert at(render(f'<image href="{uri}" width="20" height="20"/>'), 10, 10) == (0, 255, 0, 255)
    (tmp_path / "a.png").write_bytes(write.png(px))
    assert render(f'<image href="{tmp_path}/a.png" width="20" height="20"/>').sum() == 0


@pytest.mark.parametrize("t, x", [(0, 0), (1, 20), (2, 40), (9, 40)])
def test_animation(t, x):
    body = '<rect width="10" height="10" fill="red"><animate attributeName="x" from="0" to="40" dur="2s" fill="freeze"/></rect><rect y="20" width="10" height="10" fill="blue"><animateTransform attributeName="transform" type="translate" values="0 0; 20 0; 40 0" dur="2s" fill="freeze"/></rect>'
    px = render(body, time=t)
    assert at(px, x + 5, 5) == RED and at(px, x + 5, 25) == BLUE and at(px, x + 11, 5) == NONE


def test_text():
    px = render('<text x="10" y="40" font-size="20" fill="red">a b</text>', glyph=lambda c: b"\xff" * 8)
    assert at(px, 12, 30) == RED and at(px, 27, 30) == NONE and at(px, 40, 30) == RED and at(px, 12, 42) == NONE


@pytest.mark.parametrize("data, text", [(b"<html/>", "missing SVG root"), (b'<svg width="0" height="5"/>', "invalid SVG dimensions"), (b'<svg width="99999" height="99999"/>', "image too large")])
def test_errors(data, text):
    with pytest.raises(ImageError, match=text):
        svg.decode(data)


def test_rows(spark):
    from pixelloom.sources import images

    rows = [("a", bytearray(b'<svg width="4" height="4"><rect width="4" height="4" fill="red"/></svg>'))]
    got = images.decode_images(spark.createDataFrame(rows, "path string, content binary"), supersampling=1).first()
    assert (got.format, got.width, got.error) == ("svg", 4, None) and got.rgba == bytes(RED) * 16


def test_masks_and_patterns():
    defs = '<defs><mask id="m"><rect width="50" height="80" fill="white"/><rect x="50" width="20" height="80" fill="#808080"/></mask><mask id="a" mask-type="alpha"><rect width="50" height="80" opacity="0.5"/></mask><pattern id="p" patternUnits="userSpaceOnUse" width="10" height="10"><rect width="5" height="10" fill="red"/></pattern><pattern id="q" width="0.5" height="1"><rect width="10" height="20" fill="blue"/></pattern></defs>'
    px = render(defs + '<rect width="100" height="20" fill="red" mask="url(#m)"/><rect y="20" width="100" height="20" fill="blue" mask="url(#a)"/><rect y="40" width="100" height="20" fill="url(#p)"/><rect y="60" width="40" height="20" fill="url(#q)"/>').astype(int)
    assert at(px, 10, 10) == RED and abs(px[10, 60, 3] - 128) <= 1 and px[10, 80, 3] == 0
    assert px[30, 10, 3] == 128 and px[30, 60, 3] == 0
    assert at(px, 2, 50) == RED and px[50, 7, 3] == 0 and at(px, 92, 50) == RED
    assert at(px, 25, 70) == BLUE and px[70, 15, 3] == 0


@pytest.mark.parametrize("t, x, c", [(0, 0, 0), (0.5, 20, 128), (1, 40, 255), (1.5, 20, 128), (2.5, 0, 0)])
def test_keyframes(t, x, c):
    css = "<style>@keyframes go{from{transform:translate(0px,0)} to{transform:translate(40px,0)}} @keyframes hue{0%{fill:#000000}100%{fill:#ff0000}} #a{animation: go 1s linear 2 alternate forwards} .b{animation: hue 1000ms 0s alternate 2 both}</style>"
    px = render(css + '<rect id="a" width="10" height="10" fill="blue"/><rect class="b" y="20" width="10" height="10"/>', time=t)
    assert at(px, x + 5, 5) == BLUE and abs(int(px[25, 5, 0]) - c) <= 1
