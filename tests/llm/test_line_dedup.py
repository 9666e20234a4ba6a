from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixelloom.llm import line_dedup
from tests.llm import brute

SCHEMA = "doc_id long, text string, n_lines long, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, -1, 7) for i, t in rows], SCHEMA).repartition(3)


def expected(rows):
    """{doc_id: (text, n_lines, n_dropped)} by comparing all pairs of distinct lines."""
    rows = sorted(rows)
    lines = [(i, k, x) for i, t in rows for k, x in enumerate((t or "").split("\n")) if brute.words(x)]
    distinct = sorted({x for _, _, x in lines})
    by_size = defaultdict(list)
    for n, x in enumerate(distinct):
        by_size[len(x)].append(n)
    links = []
    for n, x in enumerate(distinct):
        for size in range(len(x), len(x) + 3):
            for m in by_size[size]:
                most = min(2, len(x) // 10)
                if m != n and size - len(x) <= most and brute.edit_distance(x, distinct[m]) <= most:
                    links.append((n, m))
    comp = dict(zip(distinct, brute.classes(len(distinct), links)))
    first = {}
    for i, k, x in lines:
        first.setdefault(comp[x], (i, k))
    out = {}
    for i, t in rows:
        left, n, gone = [], 0, 0
        for k, x in enumerate((t or "").split("\n")):
            n += bool(brute.words(x))
            if brute.words(x) and first[comp[x]] != (i, k):
                gone += 1
            else:
                left.append(x)
        out[i] = (None if t is None else "\n".join(left), n, gone)
    return out


def planted():
    rnd = random.Random(4)

    def line(n):
        return "".join(rnd.choice("abé ü語") for _ in range(n - 1)) + "x"

    def edit(x, k):
        for _ in range(k):
            p = rnd.randrange(len(x) + 1)
            x = rnd.choice([x[:p] + "Q" + x[p:], x[:p] + x[p + 1 :], x[:p] + "é" + x[p + 1 :]])
        return x

    base = [line(n) for n in (5, 9, 10, 11, 15, 19, 20, 21, 22, 30, 31, 32, 60, 61)]
    rows = []
    for i in range(60):
        rows.append((i, "\n".join(edit(rnd.choice(base), rnd.randrange(4)) for _ in range(6)) + "\n \n"))
    # A family that shares a segment in every member.
    rows += [(100 + i, f"Page {i:02d} of the annual report on everything") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "\n\n"), (203, "same\nsame\nsame"), (204, "tail\r\ntail"), (205, "tail")]
    return rows


@pytest.mark.parametrize("kind", ["planted", "sf"])
def test_lines_match_brute_force(spark, kind):
    if kind == "planted":
        rows = planted()
    else:
        rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = line_dedup.line_dedup(frame(spark, rows), block_bytes=1000 if kind == "planted" else 50_000).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == expected(rows)
    assert got[0].node == 7


def test_pairs_of_a_family_that_shares_segments(spark):
    """Lines that share a half and are alike in pairs only, so the star brings little and the rest meets by two segments."""
    rnd = random.Random(9)
    half = "the half that every line of this family has "
    ends = ["".join(rnd.choice("abcdefghij") for _ in range(30)) for _ in range(90)]
    rows = [(i, half + e) for i, e in enumerate(ends)] + [(100 + i, half + e[:7] + "Q" + e[8:20] + e[21:]) for i, e in enumerate(ends)]
    got = line_dedup.line_dedup(frame(spark, rows), block_bytes=1000).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == expected(rows)
    assert sum(r.n_dropped for r in got) >= 90


def test_two_segments_write_what_lines_hold(spark, monkeypatch):
    """Six keys a line; its probes, some eleven times as many, become rows only if a line may hold them."""
    rnd = random.Random(3)
    lines = ["".join(rnd.choice("abcdefghij") for _ in range(40)) for _ in range(300)]
    lines += [x[:5] + "Q" + x[6:30] + x[31:] for x in lines[:60]]
    nodes = spark.createDataFrame([(1, n, n, [int(c) for c in line_dedup.histogram(x)], x) for n, x in enumerate(lines)], "grp long, node long, comp long, sketch array<tinyint>, text string")
    written, write = {}, line_dedup.stage
    monkeypatch.setattr(line_dedup, "stage", lambda df, name: written.setdefault(name, write(df, name)))
    pairs = {tuple(sorted(r)) for r in line_dedup.by_two_segments(nodes.drop("text"), nodes.select("node", "text")).collect()}
    assert pairs >= {(n, 300 + n) for n in range(60)}
    assert written["two-segments"].count() == 6 * len(lines)


@settings(max_examples=300, deadline=None)
@given(st.text("abé", min_size=10, max_size=45), st.lists(st.tuples(st.integers(0, 44), st.sampled_from("idr")), max_size=2), st.integers(1, 2))
def test_alike_lines_share_keys(a, edits, chosen):
    b = a
    for p, kind in edits:
        b = b[:p] + "c" + b[p:] if kind == "i" else b[:p] + b[p + 1 :] if kind == "d" else b[:p] + "c" + b[p + 1 :]
    most = min(len(a), len(b)) // 10
    if a == b or most == 0 or brute.edit_distance(a, b) > min(2, most):
        return
    x, y = a.encode(), b.encode()
    data = np.frombuffer(x + y, np.uint8)
    line, key, probe = line_dedup.segment_keys(data, np.array([0, len(x)]), np.array([len(x), len(data)]), chosen)
    sides = [(set(key[(line == k) & ~probe].tolist()), set(key[line == k].tolist())) for k in (0, 1)]
    assert sides[0][0] & sides[1][1] or sides[1][0] & sides[0][1]


def test_equal_rows_and_none(spark):
    got = line_dedup.line_dedup(frame(spark, [(1, "a line"), (1, "a line"), (2, "a line")])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "a line"), (1, "a line"), (2, "")]
    assert line_dedup.line_dedup(frame(spark, [(1, "x")]).where("doc_id < 0")).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12), st.integers(0, 3))
def test_banded_edit_distance(a, b, most):
    assert line_dedup.edit_distance(a, b, most) == min(brute.edit_distance(a, b), most + 1)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=20, max_size=40), st.lists(st.tuples(st.integers(0, 39), st.sampled_from("iadr")), max_size=4), st.integers(1, 3))
def test_banded_edit_distance_of_near_texts(a, edits, most):
    b = a
    for p, kind in edits:
        b = b[:p] + "c" + b[p:] if kind == "i" else b[:p] + b[p + 1 :] if kind == "d" else b[:p] + "c" + b[p + 1 :]
    assert line_dedup.edit_distance(a, b, most) == min(brute.edit_distance(a, b), most + 1)


def test_null_ids(spark):
    got = line_dedup.line_dedup(frame(spark, [(None, "a line here\nb"), (1, "a line here\nc"), (2, None)])).collect()
    assert {(r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got} == {(None, "a line here\nb", 2, 0), (1, "c", 2, 1), (2, None, 0, 0)}
