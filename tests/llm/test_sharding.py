from __future__ import annotations

import shutil
import zlib

from pyspark.sql import functions as F

from tillcast.llm import sharding
from tillcast.llm.queries import op2_sharding
from tillcast.llm.tables import with_row_id


def check(rows, n_docs, shards, largest):
    assert len(rows) == n_docs
    sizes, slots = [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    mean = sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= 2 * largest + 0.002 * mean
    return sizes


def test_query(spark, sf_oracle):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_oracle}/documents.parquet").collect()}
    rows = op2_sharding(spark, sf_oracle).collect()
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, zlib.crc32(data), "bytes", None)
    check(rows, len(docs), 16, max(r["size"] for r in rows))
    assert sorted(rows) == sorted(op2_sharding(spark, sf_oracle).collect())


def test_hot_rows_pieces_and_odd_rows(spark, tmp_path):
    rows = [(1, "copy " * 10)] * 3000 + [(i, "t" * (i % 50)) for i in range(2000)] + [(None, None), (5, ""), (6, "é" * 4000)]
    df = spark.createDataFrame([(i, t, "old") for i, t in rows], "doc_id long, text string, Slot string").repartition(7)
    df.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    got = sharding.shard_rows(docs, 16, key_columns=["doc_id", "text"], piece_bytes=4000)
    assert got.columns == ["doc_id", "text", "size", "shard", "slot"]
    out = got.collect()
    check(out, len(rows), 16, max(r["size"] for r in out))
    copies = [sum(1 for r in out if r.shard == s and r.doc_id == 1 and len(r.text or "") == 50) for s in range(16)]
    assert min(copies) > 50  # copies are spread
    assert {r["size"] for r in out if r.text is None} == {1}


def dealt_by_brute_force(keyed, shards):
    """Rows sorted by key, cut at the places nearest to the targets: shard and slot of each key."""
    keyed, places, below, shard = sorted(keyed), {}, 0, 0
    total, start = sum(size for _, size in keyed), 0
    for place, (key, size) in enumerate(keyed):
        while shard < shards - 1 and below + size >= (target := total * (shard + 1) / shards) and not target - below > below + size - target:
            shard, start = shard + 1, place
        places[key] = (shard, place - start)
        below += size
    return places


def test_every_row_goes_where_its_key_says(spark, tmp_path):
    rows = [(i % 500, "copy of a row" if i % 3 == 0 else "text " * (i % 37), i) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int").repartition(5)
    docs.write.parquet(str(tmp_path / "docs"))
    shutil.copytree(tmp_path / "docs", tmp_path / "elsewhere" / "docs")
    here, there = (spark.read.parquet(str(tmp_path / x)) for x in ("docs", "elsewhere/docs"))
    keys = with_row_id(here, "row").select("piece", sharding.row_key(["doc_id", "text"], "row").alias("key"), sharding.row_size(F.col("text")).alias("size")).collect()
    want = dealt_by_brute_force([(r.key, r["size"]) for r in keys], 7)
    for df in (here, there):
        got = sharding.shard_rows(df, 7, key_columns=["doc_id", "text"], tolerance=0, piece_bytes=4000)
        assert {r.piece: (r.shard, r.slot) for r in got.collect()} == {r.piece: want[r.key] for r in keys}


def test_columns_of_any_name_are_kept(spark):
    names = ["_key", "_piece", "_in_piece", "_first", "key", "row", "piece", "at", "first", "n"]
    docs = spark.createDataFrame([(i, "x" * i, *range(10)) for i in range(20)], ["doc_id", "text", *names])
    got = sharding.shard_rows(docs, 3, key_columns=["doc_id"])
    assert got.columns == ["doc_id", "text", *names, "size", "shard", "slot"]
    assert all(tuple(r)[2:12] == tuple(range(10)) for r in got.collect())


def test_few_and_no_rows(spark):
    few = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted(r.slot for r in sharding.shard_rows(few, 16, key_columns=["doc_id"]).collect()) in ([0, 0], [0, 1])
    assert sharding.shard_rows(few.limit(0), 16, key_columns=["doc_id"]).count() == 0
