from __future__ import annotations

from hashlib import sha256

import duckdb
import pytest

from pixelloom.llm import chat, exact_dedup, mixing, quality
from pixelloom.llm.queries import QUERIES
from pixelloom.llm.sql import ORACLE
from tests.llm import brute

SF = "/root/testdata/sf0.001"
CLASH = "doc_id long, text string, source string, n_words long, norm string, digest string, rate double, kept boolean"


def frame(spark, rows):
    """(doc_id, text, source) beside columns that operators use inside."""
    return spark.createDataFrame([(i, t, s, -1, "x", "y", 9.0, None) for i, t, s in rows], CLASH).repartition(3)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_sql(spark, name):
    db = duckdb.connect()
    for table in ("documents", "conversations"):
        db.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = QUERIES[name](spark, SF), db.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    rows = sorted(tuple(r[c] for c in order) for r in got.collect())
    assert rows == sorted(tuple(r[want.columns.index(c)] for c in order) for r in want.fetchall())


def windows(text):
    w = brute.words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    covered = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
    return len(covered)


ODD = [
    (1, None, "a"), (2, "", None), (3, "one", "b"), (4, "a b c d e a b c d e f", "b"), (5, "x x x x x x x", "c"), (6, "l 1\nl 1\n\n \nl 1\nl 2", "c"),
    (7, "#*$%&|<> é ü \x1cz", "c"), (8, "the " * 2000, "d"), (9, "A b", "Ä"), (9, "A b", "Ä"), (None, "a b", "a"), (10, "a  B\t\x0bc\r\n", None),
]


def test_quality_counts(spark):
    got = {}
    for r in quality.quality(frame(spark, ODD)).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t, _ in ODD:
        for r in got[i]:
            words = brute.words(t)
            lines = [x for x in (t or "").split("\n") if brute.words(x)]
            assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
            assert r.n_symbols == sum((t or "").count(c) for c in "#*$%&|<>")
            assert r.n_dup_lines == len(lines) - len(set(lines))
            assert r.n_repeat_words == windows(t) if len(words) < 100 else r.n_repeat_words == len(words)
            assert r.base_failed == (len(words) < 10 or 100 * r.n_repeat_words > 20 * len(words))
            assert not (r.base_failed and r.kept)
    assert len(got[9]) == 2
    assert quality.quality(frame(spark, ODD).where("false")).count() == 0
    kept = quality.keep_documents(frame(spark, [(1, "The cat sat on the mat and looked at the dog in the yard", "a"), (2, "no", "a")]))
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == [c.split()[0] for c in CLASH.split(", ")]


def lowered(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.mark.parametrize("bits", [None, 2])
@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(spark, bits, keep):
    rows = [(1, "Ab", "s"), (2, "aB", "s"), (3, "É", "s"), (4, "é", "s"), (5, None, "s"), (6, "", "s"), (7, "x" * 5000, "s"), (8, "ab", "s"), (8, "ab", "s"), *((20 + k, f"t{k % 7}", "s") for k in range(30))]
    options = {} if bits is None else {"digest": exact_dedup.weak_digest(bits)}
    got = exact_dedup.exact_dedup(frame(spark, rows), keep=keep, **options).collect()
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(lowered(t), []).append(i)
    assert len(got) == len(rows)
    by_id = {i: lowered(t) for i, t, _ in rows}
    for r in got:
        g = groups[by_id[r.doc_id]]
        best = (min if keep == "min" else max)(g)
        assert (r.keep_id, r.group_size, r.kept) == (best, len(g), r.doc_id == best)
        assert r.text_sha256 == sha256(by_id[r.doc_id].encode()).hexdigest()
    assert exact_dedup.exact_dedup(frame(spark, rows).where("false")).count() == 0


def test_digest_index(spark):
    from pyspark.sql import functions as F

    index = exact_dedup.DigestIndex(spark)
    for start in (0, 50):
        index.flush(spark.range(start, start + 100).select("id", F.unhex(F.md5((F.col("id") % 60).cast("string"))).alias("digest")))
    assert len(index.levels[0]) == 2
    found = index.compact()
    assert found.count() == 60 and list(index.levels) == [1]
    one = F.unhex(F.md5(F.lit("7")))
    digest = spark.range(1).select(one.alias("d")).first().d
    r = index.lookup([digest]).first()
    assert (r.n, r.min_id, r.max_id) == (4, 7, 127)


def water(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by the iteration: cap what is above, share the excess by weight, until none is above."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, set(names)
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: most * sizes[s] for s in over}
        open_ -= over
    return target


def test_mixing(spark):
    rows = [(k, "w " * (k % 9), ["a", "b", None, "Z", "c", "empty"][k % 6] if k % 9 else "empty") for k in range(3000)]
    rows = [(i, t if s != "empty" else None, s) for i, t, s in rows]
    got = mixing.mixing_plan(frame(spark, rows)).collect()
    again = mixing.mixing_plan(frame(spark, rows).repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    sizes, taken, source = {}, {}, {i: s for i, _, s in rows}
    for i, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    want = water(sizes)
    for r in got:
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        assert r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 and r.taken <= 2 * r.size
    for s, w in want.items():
        assert abs(taken[s] - w) <= 0.1 * w + 1
    mixed = mixing.mix(frame(spark, rows)).groupBy("doc_id").count().collect()
    copies = {r.doc_id: r["count"] for r in mixed}
    assert all(r.taken == r.size * copies.get(r.doc_id, 0) for r in got)
    assert mixing.mixing_plan(frame(spark, rows).where("false")).count() == 0
    assert mixing.mix(frame(spark, rows).where("false")).count() == 0
    assert {r.taken for r in mixing.mixing_plan(frame(spark, [(1, None, None), (2, "", "a")])).collect()} == {0}


def test_mixing_without_a_broadcast(spark, monkeypatch):
    rows = [(k, "w w", f"s{k % 5}") for k in range(200)]
    small = sorted(map(tuple, mixing.mixing_plan(frame(spark, rows)).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mixing_plan(frame(spark, rows)).collect())) == small


TURNS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "<|end|>"), (1, 2, "assistant", "more <\\|x <\\\\|"), (1, 3, "user", None), (2, 0, None, "<|role|>a<|text|>"), (2, 0, "user", "tie"),
    (3, None, "assistant", ""), (None, 1, "assistant", "lost id"), (4, 0, "ass<|ist", "<"), (4, 1, "assistant", "|end|>"), (5, 0, "assistant", "x" * 30000),
]


def test_chats(spark):
    df = spark.createDataFrame([(*t, "x", 1) for t in TURNS], "conv_id long, turn long, role string, text string, formatted string, ts int").repartition(3)
    formatted = chat.format_chats(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    convs = {}
    for c, t, role, text in TURNS:
        convs.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        mask = "".join(x for _, role, x in turns if role == "assistant")
        said = "".join(f"{role}\n{x}\n" for _, role, x in turns)
        r = got[c]
        assert (r.n_turns, r.loss_chars) == (len(turns), len(mask))
        assert (r.turns_sha256, r.loss_sha256) == (sha256(said.encode()).hexdigest(), sha256(mask.encode()).hexdigest())
    text = {r.conv_id: r.formatted for r in formatted.collect()}
    assert text[1].startswith("<|role|>user<|text|>hi<|end|><|role|>assistant<|text|><\\|end|><|more|>more ")
    assert all(got[c].formatted_chars == len(text[c]) for c in text)
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0
