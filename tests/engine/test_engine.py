from __future__ import annotations

import base64
import os
import re
import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from pixelloom.operators import quantize
from pixelloom.plans.registry import ORACLE, QUERIES
from pixelloom.sinks import kitty, sixel, terminal
from pixelloom.sources import images
from pixelloom.sources.codecs import write

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for name in os.listdir(SF):
        found.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return found


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    if name not in ORACLE:
        assert rows
        return
    want = db.sql(ORACLE[name])
    assert want.columns == got.columns
    assert sorted(map(repr, rows)) == sorted(map(repr, want.fetchall()))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_part(tmp_path):
    for part in ("pixelloom", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / part), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "pixelloom/llm")], check=True)
    code = "import __spark_entry__ as e; assert e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_files_from_disk(spark, tmp_path):
    px = np.random.default_rng(1).integers(0, 256, (5, 4, 4), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(write.png(px))
    (tmp_path / "b.tif").write_bytes(write.tiff([px, px]))
    (tmp_path / "c.txt").write_bytes(b"plain text")
    (tmp_path / "d.svg").write_bytes(b"<?xml version='1.0'?><SVG/>")
    (tmp_path / "e.png").write_bytes(write.png(px)[:60])
    (tmp_path / "f.gif").write_bytes(b"")
    df = images.with_format(images.files(spark, f"file://{tmp_path}"))
    kinds = {r.path[-5:]: (r.format, r.error) for r in df.collect()}
    assert kinds["a.png"] == ("png", None) and kinds["d.svg"] == ("svg", None)
    assert kinds["c.txt"] == (None, "unknown image format")
    assert "f.gif" not in kinds  # the scan leaves out files without a byte
    none = images.with_format(spark.createDataFrame([("f", bytearray())], "path string, content binary")).first()
    assert (none.format, none.error) == (None, "empty file")
    got = {(r.path[-5:], r.page): r for r in images.decode_images(df, page="all").collect()}
    assert got["b.tif", 1].rgba == px.tobytes() and got["a.png", 0].rgba == px.tobytes()
    assert got["e.png", 0].error and got["d.svg", 0].width == 512
    one = images.assemble_pixels(images.explode_pixels(images.decode_images(df.where("format = 'png' and length > 70"))), "path").collect()
    assert [r.rgba for r in one] == [px.tobytes()]
    small = images.decode_images(df.where("format = 'png'"), max_pixels=3).where("path like '%a.png'").collect()
    assert small[0].error == "image too large"


def test_length_filter_reaches_the_scan(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    df = images.files(spark, f"file://{tmp_path}").where("length > 4")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[.*GreaterThan\(length,4\)", plan)


def unpack_kitty(text: str) -> tuple[list[str], bytes]:
    parts = re.findall("\x1b_G([^;\x1b]*);([^\x1b]*)\x1b\\\\", text)
    return [p[0] for p in parts], base64.b64decode("".join(p[1] for p in parts))


def test_kitty(spark):
    red = np.tile(np.array([255, 0, 0, 255], np.uint8), (100, 100, 1))
    df = spark.createDataFrame([("a", 100, 100, bytearray(red.tobytes()))], "path string, width int, height int, rgba binary")
    text = kitty.still(df, columns=80, rows=24).first().kitty
    heads, data = unpack_kitty(text)
    assert data == red.tobytes() and text.endswith("\x1b\\\n")
    assert heads[0] == "f=32,s=100,v=100,c=80,r=24,i=1,p=1,a=T,q=1,m=1" and heads[-1] == "m=0"
    sizes = [len(p) for p in re.findall(r"m=\d;([^\x1b]*)", text)]
    assert sizes[0] == 3800 and set(sizes[1:-1]) <= {4088} and sum(sizes) == 4 * -(-40000 // 3)
    for raw, want in ((b"", ""), (b"Man", "TWFu"), (b"Ma", "TWE="), (b"M", "TQ==")):
        one = spark.createDataFrame([(bytearray(raw),)], "b binary")
        assert one.select(kitty.base64_text(one.b)).first()[0] == want
    one = spark.range(1).selectExpr("42 as i", "7 as p")
    assert one.select(kitty.delete_all(), kitty.delete_image(one.i), kitty.delete_placement(one.i, one.p)).first()[:] == (
        "\x1b_Ga=d\x1b\\", "\x1b_Ga=d,d=i,i=42\x1b\\", "\x1b_Ga=d,d=p,i=42,p=7\x1b\\")


def test_kitty_animation(spark):
    rows = [("a", k, d, 1, 1, bytearray([k, 0, 0, 255])) for k, d in ((0, 30), (1, 70))]
    df = spark.createDataFrame(rows, "path string, frame_no int, delay_ms long, width int, height int, rgba binary")
    text = kitty.animation(df).first().kitty
    assert "a=f,i=1,s=1,v=1,z=70,q=1,m=0;" in text
    assert text.endswith("\x1b_Ga=a,i=1,r=1,z=30,q=1\x1b\\\x1b_Ga=a,i=1,s=3,v=1,q=1\x1b\\\n")


def read_sixel(text: str) -> np.ndarray:
    """Sixel text back to palette indices."""
    head = re.match(r'\x1bPq"1;1;(\d+);(\d+)((?:#\d+;2;\d+;\d+;\d+)*)', text)
    w, h = int(head[1]), int(head[2])
    out = np.full((h, w), -1)
    for band, line in enumerate(text[head.end() : -3].split("-")):
        for part in line.split("$"):
            color, body = re.match(r"#(\d+)(.*)", part, re.S).groups()
            x = 0
            for n, c in re.findall(r"(?:!(\d+))?([?-~])", body):
                for _ in range(int(n or 1)):
                    for bit in range(6):
                        if ord(c) - 63 >> bit & 1:
                            out[band * 6 + bit, x] = int(color)
                    x += 1
            assert x == w
    return out


def test_sixel(spark):
    rng = np.random.default_rng(3)
    idx = rng.integers(0, 4, (14, 9)).astype(np.uint8)
    idx[2:5] = 1
    palette = [(0, 0, 0), (255, 0, 0), (0, 255, 0), (10, 20, 30)]
    text = sixel.encode(idx, palette)
    assert np.array_equal(read_sixel(text), idx) and "#3;2;3;7;11" in text and text.endswith("\x1b\\\n")
    rows = [(5, x, y, int(idx[y, x])) for y in range(14) for x in range(9)]
    df = spark.createDataFrame(rows, "img int, x int, y int, idx int")
    assert sixel.sixel(df, palette, 9, 14).first().sixel == text


def test_octree_and_diffusion():
    few = np.array([[[255, 0, 0], [0, 255, 0]], [[0, 0, 255], [255, 0, 0]]], np.uint8)
    idx, palette = quantize.quantize(few)
    assert [palette[k] for k in idx.reshape(-1)] == [(255, 0, 0), (0, 255, 0), (0, 0, 255), (255, 0, 0)]
    many = np.random.default_rng(2).integers(0, 256, (20, 20, 3)).astype(np.uint8)
    for dither in ("none", "ordered", "floyd-steinberg", "atkinson"):
        idx, palette = quantize.quantize(many, 16, dither)
        assert len(palette) <= 16 and idx.max() < len(palette)
    gray = np.full((8, 8, 3), 128, np.uint8)
    two = np.array([[0, 0, 0], [255, 255, 255]])
    assert abs(quantize.diffuse(gray, two, "floyd-steinberg").mean() - 0.5) < 0.1


def test_terminals():
    assert not terminal.is_kitty({}) and terminal.is_kitty({"TERM": "xterm-kitty"}) and terminal.is_kitty({"KITTY_WINDOW_ID": "1"})
    assert terminal.is_sixel({"TERM": "foot"}) and terminal.is_sixel({"VTE_VERSION": "5200"}) and not terminal.is_sixel({"VTE_VERSION": "5199"})
    assert terminal.backend({"TERM": "kitty"}) == "kitty" and terminal.backend({}) == "ansi"
    assert terminal.backend({"TERM": "xterm-kitty"}) == "sixel" and terminal.backend({"TERM": "xterm"}, force_ansi=True) == "ansi"


def test_sixel_animation(spark):
    rows = [("a", k, d, 2, 1, bytearray([255, 0, 0, 255] * 2)) for k, d in ((0, 10), (1, 70))]
    df = spark.createDataFrame(rows, "path string, frame_no int, delay_ms long, width int, height int, rgba binary")
    got = sixel.animation(df).first()
    assert got.total_ms == 170 and got.sixel.startswith("\x1b[?25l\x1b7\x1b8\x1bPq") and got.sixel.endswith("\x1b[?25h")
