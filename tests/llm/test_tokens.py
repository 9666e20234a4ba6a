from __future__ import annotations

import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from pixelloom.llm import packing, token_store
from pixelloom.llm.tokens import Encoder, tokenizer_path

SCHEMA = "doc_id long, text string, payload string, length int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "p", 1) for i, t in rows], SCHEMA).repartition(3)


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def ids_of(rows):
    got = library().encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return {i: np.array([*e.ids, 2], "<u4") for (i, _), e in zip(rows, got)}


@pytest.fixture(scope="module")
def rows(spark):
    out = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    long = " ".join(t for _, t in out)
    return [*out, (9000, None), (9001, ""), (9002, long), (9003, long + " end"), (9004, "<|endoftext|>  x\n \ny")]


def test_encoder_agrees_with_the_library():
    rnd = random.Random(1)
    parts = ["a", "B", " ", "  ", "\n", " \n", "\t", ".", "'s", "1", "é", "ß", "語", "<|endoftext|>", "\x1c", "\x85", "don't", "🙂", "́", "\r\n", "Ⅷ", "²", "_", "×", " x"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(30))) for _ in range(5000)]
    want = library().encode_batch(texts, add_special_tokens=False)
    for text, got, w in zip(texts, Encoder(tokenizer_path()).encode(texts), want):
        assert got.tolist() == [*w.ids, 2], repr(text)


def test_encoder_with_a_full_cache(monkeypatch):
    from pixelloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHED", 3)
    texts = ["one two three four", "two five", "", "six"]
    want = library().encode_batch(texts, add_special_tokens=False)
    e = Encoder(tokenizer_path())
    for _ in range(2):
        assert [g.tolist() for g in e.encode(texts)] == [[*w.ids, 2] for w in want]


def test_store_round_trip(spark, rows):
    got = sorted(token_store.token_store(frame(spark, rows)).collect(), key=lambda r: r.doc_id)
    ids, start = ids_of(rows), 0
    assert [r.doc_id for r in got] == sorted(ids)
    for r in got:
        x = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(x), crc32(x.tobytes()))
        start += len(x)


def test_store_holds_each_chunk_once_and_finds_damage(spark, rows, tmp_path):
    root = f"file://{tmp_path}/store"
    token_store.write_store(frame(spark, rows), root)
    chunks = spark.read.parquet(f"{root}/chunks")
    kept = chunks.where("payload is not null")
    assert kept.count() == kept.select("address").distinct().count() == chunks.select("address").distinct().count()
    assert kept.count() < chunks.count()
    swapped = chunks.join(kept.selectExpr("max(payload) as other")).selectExpr("address", "doc_id", "row", "seq", "n", "case when payload is not null then other end as payload")
    swapped.write.parquet(f"{root}-bad/chunks")
    with pytest.raises(Exception, match="damaged"):
        token_store.stored_chunks(spark, f"{root}-bad").collect()


def test_store_of_equal_and_no_rows(spark):
    got = token_store.token_store(frame(spark, [(1, "a b"), (1, "a b"), (0, "c")])).collect()
    assert sorted((r.doc_id, r.start) for r in got) == [(0, 0), (1, 2), (1, 5)]
    assert token_store.token_store(frame(spark, [(1, "x")]).where("doc_id < 0")).count() == 0


def test_crc_of_parts():
    rnd = np.random.default_rng(0)
    parts = [rnd.bytes(n) for n in (4, 400, 4, 100_004, 8)]
    n = np.array([len(p) for p in parts])
    after = n.sum() - np.cumsum(n)
    moved = token_store.shift_crcs(np.array([crc32(p) for p in parts]), after, token_store.crc_shifters())
    assert int(np.bitwise_xor.reduce(moved)) == crc32(b"".join(parts))


def test_packing(spark, rows):
    got = packing.pack(frame(spark, rows)).collect()
    ids, parts = ids_of(rows), defaultdict(list)
    places = defaultdict(list)
    for r in got:
        parts[r.doc_id].append(r)
        places[r.sequence_id].append((r.offset, r.length))
        assert r.ids_crc32 == crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
    assert set(parts) == set(ids)
    for i, rs in parts.items():
        rs.sort(key=lambda r: r.piece)
        assert [r.piece for r in rs] == list(range(len(rs)))
        assert [(r.start, r.length) for r in rs] == packing.cut_points(len(ids[i]), 1024)
    for spans in places.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(places) <= -(-sum(map(len, ids.values())) // 1024) * 1.02 + 1


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_plan_is_best_fit_decreasing(seed):
    rnd = random.Random(seed)
    counts = {rnd.randrange(1, 101): rnd.randrange(1, 40) for _ in range(rnd.randrange(1, 60))}
    slots = packing.plan_best_fit(counts, 100)
    rooms, bins = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - length)
            else:
                rooms.append(100 - length)
                bins += 1
    used, ranks = set(), defaultdict(list)
    cells = set()
    for length, rank, number, first, offset in slots:
        for k in range(number):
            used.add(first + k)
            ranks[length].append(rank + k)
            for c in range(offset, offset + length):
                assert (first + k, c) not in cells
                cells.add((first + k, c))
    assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in counts.items()}
    assert len(used) == bins


def test_packing_of_nothing(spark):
    assert packing.pack(frame(spark, [(1, "x")]).where("doc_id < 0")).count() == 0


def test_null_and_repeated_ids(spark):
    rows = [(None, "one two"), (None, None), (3, "one two"), (3, "one two")]
    got = packing.pack(frame(spark, rows)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in got) == [(False, 3, 3), (False, 3, 3), (True, 0, 1), (True, 0, 3)]
    kept = token_store.token_store(frame(spark, rows)).orderBy("start").collect()
    assert [r.doc_id for r in kept] == [None, None, 3, 3] and sum(r.n_tokens for r in kept) == 10 and kept[-1].start == 7


def test_plan_needs_no_python_on_executors(spark, monkeypatch):
    """Rows of a list would pass Python workers, whose processes count against an executor that encodes."""
    pieces = spark.createDataFrame(packing.pa.table({"doc_id": [1, 2], "piece": [0, 0], "length": [5, 5], "tie": [1, 2]}))
    made, make = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, *a, **b: made.append(make(self, *a, **b)) or made[-1])
    assert sorted((r.sequence_id, r.offset) for r in packing.place(pieces).collect()) == [(0, 0), (0, 5)]
    assert packing.place(pieces.where("piece > 0")).count() == 0
    lineage = [df._jdf.queryExecution().toRdd().toDebugString() for df in made]
    assert len(lineage) == 4 and not any("PythonRDD" in x for x in lineage)


def test_workers_hold_little():
    """A cache that is full holds some 50 MB, and freed memory of Arrow goes back to the system."""
    import re
    import sys
    from pathlib import Path

    from pixelloom.llm import tokens
    from pixelloom.llm.textnum import trim

    e = Encoder(tokenizer_path())
    for k in range(0, 500_000, 20_000):
        e.encode([" ".join(f"{x}" for x in range(k, k + 20_000))])
    assert 200_000 < len(e.pieces) <= tokens.CACHED
    assert sys.getsizeof(e.pieces) + sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in e.pieces.items()) < 64e6

    def held():
        return int(re.search(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    trim()
    before = held()
    parts = [packing.pa.array(np.ones(20_000, np.int64)).take(packing.pa.array(np.arange(20_000))) for _ in range(1500)]
    full = held()
    del parts
    trim()
    assert full - before > 150 and held() - before < 0.25 * (full - before)
