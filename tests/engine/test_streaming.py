from __future__ import annotations

import numpy as np

from pixelloom.sources.codecs import write
from pixelloom.streaming import files


def test_files_are_decoded_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    px = np.random.default_rng(0).integers(0, 256, (3, 4, 4), dtype=np.uint8)
    (source / "a.png").write_bytes(write.png(px))
    (source / "b.png").write_bytes(b"broken")
    for k in range(2):
        query = files.decode_to(files.arriving(spark, f"file://{source}"), f"file://{tmp_path}/out", f"file://{tmp_path}/marks")
        query.awaitTermination(120)
        assert query.exception() is None
        rows = {r.path[-5:]: r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
        assert len(rows) == 2 + k and rows["a.png"].rgba == px.tobytes() and rows["b.png"].error == "unknown image format"
        (source / "c.tga").write_bytes(write.tga32(px))
