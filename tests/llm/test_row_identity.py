from __future__ import annotations

import pytest

from tillcast.llm import sharding, simhash

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(i, " ".join(f"w{i % 300}x{j}" for j in range(30))) for i in range(600)]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.option("parquet.block.size", 4096).parquet(path)
    yield spark.read.parquet(path)
    spark.conf.unset(SPLIT)


def test_near_duplicates_when_files_are_split_anew(spark, stored):
    kept = simhash.keep_one_of_each(stored)
    spark.conf.set(SPLIT, "3000")  # the second read has other partitions than the first
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))


def test_shards_when_files_are_split_anew(spark, stored):
    dealt = sharding.shard_rows(stored, 4, key_columns=["text"], piece_bytes=4000)
    spark.conf.set(SPLIT, "3000")
    rows = dealt.collect()
    assert sorted(r.doc_id for r in rows) == list(range(600))
    for s in range(4):
        slots = sorted(r.slot for r in rows if r.shard == s)
        assert slots == list(range(len(slots)))
