"""Operators return what they made; the queries' digests are taken from that."""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256
from zlib import crc32

import pytest

from pixelloom.llm import packing, queries, repeats
from tests.llm import brute
from tests.llm.test_near_and_repeats import docs, frame
from tests.llm.test_tokens import ids_of

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("kind", ["planted", "sf"])
def test_repeats_give_kept_bytes_and_removed_ranges(spark, kind):
    a, b = "0123456789é" * 5, "abcdefghijkü" * 6
    rows = [(1, a + "x" + b), (2, "-" + a + "--" + b + "-"), (3, b), (4, a[2:] + b[3:]), (5, None), (6, a + "x" + b), (7, ""), (8, "z" * 49)]
    rows = docs(spark) if kind == "sf" else rows
    texts, want = {i: (t or "").encode() for i, t in rows}, brute.repeats(rows)
    got = repeats.repeated_substrings(frame(spark, rows), block_bytes=60_000 if kind == "sf" else 300).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        text, left, at = texts[r.doc_id], b"", 0
        for start, end in r.removed:
            assert at <= start < end <= len(text) and (at < start or at == 0)
            left, at = left + text[at:start], end
        left += text[at:]
        assert bytes(r.kept) == left
        removed = sum(end - start for start, end in r.removed)
        assert (len(text), removed, len(r.removed), sha256(left).hexdigest()) == want[r.doc_id]
    if kind == "planted":
        assert {r.doc_id: [tuple(s) for s in r.removed] for r in got}[2] == [(1, 61), (63, 141)]


def test_op9_keeps_its_contract(spark):
    assert queries.op9_suffix_array_dedup(spark, SF).columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_packing_gives_the_ids_of_its_sequences(spark):
    rows = [*docs(spark)[:300], (9000, None), (9001, "word " * 3000)]
    ids, places = ids_of(rows), defaultdict(list)
    packed = packing.pack(frame(spark, rows)).cache()
    for r in packed.collect():
        want = ids[r.doc_id][r.start : r.start + r.length].tobytes()
        assert bytes(r.ids) == want and r.ids_crc32 == crc32(want)
        places[r.sequence_id].append((r.offset, want))
    got = {r.sequence_id: (r.n_tokens, bytes(r.ids)) for r in packing.sequences(packed).collect()}
    whole = {k: b"".join(x for _, x in sorted(v)) for k, v in places.items()}
    assert got == {k: (len(x) // 4, x) for k, x in whole.items()}


def test_op5_and_pipeline_keep_their_contract(spark):
    import corpus_pipeline

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert queries.op5_best_fit_packing(spark, SF).columns == columns
    docs_frame = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    assert corpus_pipeline.packed(spark, docs_frame, SF).columns == [*columns, "ids"]
