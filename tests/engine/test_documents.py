from __future__ import annotations

import numpy as np
import pytest

from pixelloom import cli
from pixelloom.sources import documents
from pixelloom.sources.codecs import write


def frame(spark, **files):
    return spark.createDataFrame([(k, bytearray(v if isinstance(v, bytes) else v.encode())) for k, v in files.items()], "path string, content binary")


def test_dimensions(spark):
    df = frame(spark, a='<svg width="10" height="2in"/>', b="<svg viewBox='0 0 30 40'>", c="<svg>", d="<?xml?><x:svg viewBox='1 2 3' height='5%' width='7px'/>")
    got = {r.path: (r.width, r.height) for r in documents.svg_dimensions(df).collect()}
    assert got == {"a": (10, 192), "b": (30, 40), "c": (512, 512), "d": (7, 512)}


def test_tags(spark):
    rows = documents.svg_tags(frame(spark, a='<svg><g id="x"><rect/></g><!-- <no/> --><circle r="1"/></svg>', b="plain")).orderBy("seq").collect()
    assert [(r.depth, r.tag, r.attrs) for r in rows] == [(0, "svg", {}), (1, "g", {"id": "x"}), (2, "rect", {}), (1, "circle", {"r": "1"})]


def test_timeline(spark):
    df = frame(
        spark, a='<svg><animate begin="1s" dur="2s" repeatCount="2"/><set/></svg>', b='<svg><animate dur="1s" repeatCount="indefinite"/></svg>',
        c="<svg><style>#a{animation: move 1500ms ease-in 0.5s 2 alternate}</style></svg>", d="<svg><style>#a{animation: m 2s infinite}</style><animate dur='500ms'/></svg>", e="<svg/>",
    )
    got = {r.path: (r.duration_s, r.indefinite) for r in documents.svg_timeline(df).collect()}
    assert got == {"a": (5.0, False), "b": (2.0, True), "c": (3.5, False), "d": (0.5, True)}


def test_frames(spark):
    df = frame(spark, a='<svg width="4" height="1"><rect width="1" height="1" fill="red"><animate attributeName="x" from="0" to="3" dur="1s" fill="freeze"/></rect></svg>')
    rows = documents.svg_frames(df, fps=3).orderBy("t").collect()
    assert [np.frombuffer(r.rgba, np.uint8).reshape(4, 4)[:, 0].argmax() for r in rows] == [0, 1, 2, 3]


def test_tga_metadata_and_icons(spark):
    px = np.random.default_rng(0).integers(0, 256, (4, 4, 4), dtype=np.uint8)
    assert documents.tga_metadata(frame(spark, a=write.tga32(px))).count() == 0
    best = documents.largest_icon(frame(spark, a=write.ico([px[:2], px, px[:3]]))).first()
    assert (best.page, best.width, best.height, best.rgba) == (1, 4, 4, px.tobytes())


@pytest.mark.parametrize("backend, start", [("ansi", "\x1b[48;2;"), ("kitty", "\x1b_Gf=32"), ("sixel", "\x1bPq")])
def test_command_line(spark, backend, start):
    df = frame(spark, a=write.png(np.full((2, 2, 4), 200, np.uint8)), b="<svg width='2' height='2'/>", c="nothing known")
    got = {r.path: r.text for r in cli.rendered(df, cli.options(["x", "--width", "2"]), backend).collect()}
    assert got["a"].startswith(start) and got["b"].startswith(start) and got["c"] == "c: unknown image format\n"


def test_command_line_prints(spark, tmp_path, capsys):
    (tmp_path / "a.png").write_bytes(write.png(np.full((1, 1, 4), 255, np.uint8)))
    assert cli.main([f"file://{tmp_path}/a.png", "--ansi"]) == 0
    assert capsys.readouterr().out == "\x1b[48;2;255;255;255m \x1b[0m\n"
