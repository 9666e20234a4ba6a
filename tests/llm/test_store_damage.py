"""Reading a store back stops where a recipe and the chunks don't agree."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pixelloom.llm import token_store
from tests.llm.test_tokens import frame

ROWS = [(1, "one two three " * 3000), (2, "four five"), (None, None), (3, " ".join(map(str, range(9000))))]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = f"file://{tmp_path_factory.mktemp('store')}/s"
    token_store.write_store(frame(spark, ROWS), root)
    return root


def altered(spark, store, root, table, change):
    for name in ("chunks", "recipes"):
        df = spark.read.parquet(f"{store}/{name}")
        (change(df) if name == table else df).write.parquet(f"{root}/{name}")
    return token_store.read_store(spark, root).select("doc_id", "ids_crc32")


def test_whole_store_reads_back(spark, store):
    assert {r.doc_id for r in token_store.read_store(spark, store).collect()} == {1, 2, 3, None}


@pytest.mark.parametrize(
    ("table", "change", "said"),
    [
        ("chunks", lambda d: d.where("not (doc_id <=> 3 and seq = 1)"), "is missing"),
        ("recipes", lambda d: d.withColumn("addresses", F.reverse("addresses")), "Merkle root differs"),
        ("recipes", lambda d: d.withColumn("merkle_root", F.sha2("merkle_root", 256)), "Merkle root differs"),
        ("recipes", lambda d: d.withColumn("n_tokens", F.col("n_tokens") + 1), "number of tokens differs"),
    ],
)
def test_differences_stop_the_job(spark, store, tmp_path, table, change, said):
    with pytest.raises(Exception, match=said):
        altered(spark, store, f"file://{tmp_path}/bad", table, change).collect()
