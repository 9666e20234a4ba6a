from __future__ import annotations

from collections import Counter, defaultdict
from zlib import crc32

import duckdb
import pytest

from pixelloom.llm.packing import cut_points
from pixelloom.llm.sql import ORACLE
from tests.llm import brute
from tests.llm.test_line_dedup import expected
from tests.llm.test_tokens import ids_of

SF = "/root/testdata/sf0.001"
pipeline = pytest.importorskip("corpus_pipeline")


def taken(rows):
    """Copies of each document by the mixing query's SQL."""
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, source varchar, text varchar)")
    db.executemany("insert into documents values (?, ?, ?)", rows)
    found = db.sql(ORACLE["op3_source_mixing"]).fetchall()
    return {r[0]: r[4] // r[1] if r[1] else 0 for r in found}


def test_stages_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "source mixing", "best-fit packing"]


def test_run_matches_brute_force(spark):
    got = pipeline.run(spark, SF).collect()
    db = duckdb.connect()
    db.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    keep = {r[0] for r in db.sql(f"select doc_id from ({ORACLE['op1_quality_rules']}) where kept").fetchall()}
    docs = {r[0]: r for r in db.sql("select doc_id, source, text from documents").fetchall() if r[0] in keep}
    cleaned = expected([(i, t) for i, _, t in docs.values()])
    texts = {i: t for i, (t, _, gone) in cleaned.items() if not gone or brute.words(t)}
    classes = brute.near_classes(list(texts.items()))
    texts = {i: t for i, t in texts.items() if classes[i] == i}
    copies = taken([(i, docs[i][1], t) for i, t in texts.items()])
    ids = ids_of(list(texts.items()))
    want = Counter()
    for i, x in ids.items():
        for piece, (start, n) in enumerate(cut_points(len(x), 1024)):
            want[i, piece, start, n, crc32(x[start : start + n].tobytes())] += copies[i]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for spans in places.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 1024
