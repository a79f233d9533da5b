from __future__ import annotations

import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tillcast.operators.ingest import accepted_rows, latest_by_key, upsert_counts
from tillcast.session import shared_checkpoint_dir
from tillcast.sources import tables
from tillcast.sources.sales_files import read_upload
from tillcast.sources.scratch import Scratch
from tillcast.streaming import totals, uploads

FILES = [
    "date,daily_sales_total\n2025-01-01,10\n2025-01-02,20\n2025-01-01,11\nbad,1\n",
    "restaurant_id,daily_sales_total,date\nr,5,2025-01-01\n,-1,2025-01-02\n",
    "date,daily_sales_total\n2025-01-02,22\n2025-01-03,30\n2025-01-03,abc\n",
    "date,total\n2025-01-01,1\n",
]


def drop(folder, i):
    path = folder / f"f{i}.csv"
    path.write_text(FILES[i])
    os.utime(path, (1_700_000_000 + 100 * i,) * 2)


def as_state(df):
    return {(r.restaurant_id, str(r.date)): int(r.daily_sales_total) for r in df.collect()}


def feed(spark, inbox, root, checkpoint):
    uploads.upload_feed(spark, str(inbox), str(root), str(checkpoint), max_files=1).awaitTermination()


def counts(spark, root):
    return {r.batch: tuple(r)[1:] for r in uploads.upload_counts_table(spark, str(root)).collect()}


def test_feed_equals_batch(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    drop(inbox, 0)
    drop(inbox, 1)
    feed(spark, inbox, root, tmp_path / "cp")
    drop(inbox, 2)
    drop(inbox, 3)
    feed(spark, inbox, root, tmp_path / "cp")
    feed(spark, inbox, root, tmp_path / "cp")

    classified, _ = read_upload(spark, str(inbox), Scratch(spark, "test"))
    numbered = classified.withColumn("batch", F.substring("file_name", 2, 1).cast("int"))
    assert as_state(tables.sales_state(spark, str(root))) == as_state(latest_by_key(accepted_rows(numbered)))
    batch_counts = {r.batch: (r.inserted, r.updated, r.skipped) for r in upsert_counts(numbered).collect()}
    streamed = counts(spark, root)
    assert streamed.pop(3) == (0, 0, 0)
    assert streamed == batch_counts == {0: (2, 1, 1), 1: (1, 0, 1), 2: (1, 1, 1)}
    rejects = spark.read.parquet(f"{root}/rejects")
    assert sorted(r.reason for r in rejects.collect()) == ["invalid_date", "invalid_sales", "negative_sales"]
    status = spark.read.parquet(f"{root}/status")
    assert {r.file_name: r.ingestion_status for r in status.collect()} == {
        "f0.csv": "ok", "f1.csv": "ok", "f2.csv": "ok", "f3.csv": "error",
    }


def test_repeated_batch_changes_nothing(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    for i in (0, 2):
        drop(inbox, i)
        uploads.apply_upload(spark, [str(inbox / f"f{i}.csv")], str(root), i)
    before = as_state(tables.sales_state(spark, str(root))), counts(spark, root)
    for i in (0, 2):
        uploads.apply_upload(spark, [str(inbox / f"f{i}.csv")], str(root), i)
    assert (as_state(tables.sales_state(spark, str(root))), counts(spark, root)) == before


def test_feed_continues_after_compaction(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    drop(inbox, 0)
    feed(spark, inbox, root, tmp_path / "cp")
    tables.compact_sales(spark, str(root), through=0)
    drop(inbox, 2)
    feed(spark, inbox, root, tmp_path / "cp")
    assert counts(spark, root)[1] == (1, 1, 1)
    assert as_state(tables.sales_state(spark, str(root))) == {
        ("restaurant_001", "2025-01-01"): 11, ("restaurant_001", "2025-01-02"): 22, ("restaurant_001", "2025-01-03"): 30,
    }


def test_checkpoint_dir_comes_from_the_session(spark):
    class Unset:
        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared_checkpoint_dir(Unset)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert shared_checkpoint_dir(spark) == configured.rstrip("/")


EVENTS = "restaurant_id string, location_id string, ts timestamp_ntz, amount decimal(18,2)"


def events(spark, rows):
    return spark.createDataFrame([("r", "l", datetime(2025, 1, d, h), a) for d, h, a in rows], EVENTS)


def test_running_totals_drop_late_rows(spark, tmp_path):
    from decimal import Decimal

    source, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    batches = [
        [(1, 1, Decimal(1)), (1, 23, Decimal(2)), (2, 5, Decimal(4))],
        [(1, 12, Decimal(8)), (9, 0, Decimal(16))],   # on time for day 1; moves the watermark to day 7
        [(1, 13, Decimal(32)), (9, 1, Decimal(64))],  # day 1 is closed
        [(20, 0, Decimal(1))],
    ]
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(EVENTS).parquet(source)
        totals.write_daily_totals(totals.daily_totals(stream), out, cp).awaitTermination()
    got = {r.date.day: int(r.daily_sales_total) for r in spark.read.parquet(out).collect()}
    assert got == {1: 11, 2: 4, 9: 80}
    on_time = events(spark, batches[0] + batches[1])
    assert {r.date.day: int(r.daily_sales_total) for r in totals.daily_totals(on_time).collect()} == {1: 11, 2: 4, 9: 16}


def test_late_rows_are_kept_aside(spark, tmp_path):
    from decimal import Decimal

    source, root, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    batches = [
        [(1, 1, Decimal(1)), (1, 23, Decimal(2)), (2, 5, Decimal(4))],
        [(1, 12, Decimal(8)), (9, 0, Decimal(16))],
        [(1, 13, Decimal(32)), (9, 1, Decimal(64))],
        [(20, 0, Decimal(1))],
    ]
    for rows in batches:
        frame = events(spark, rows)
        frame.union(frame.limit(1).withColumn("ts", F.lit(None).cast("timestamp_ntz"))).coalesce(1).write.mode("append").parquet(source)
        totals.totals_feed(spark.readStream.schema(EVENTS).parquet(source), root, cp).awaitTermination()
    closed = {r.date.day: (int(r.daily_sales_total), r.n) for r in totals.closed_totals(spark, root).collect()}
    assert closed == {1: (11, 3), 2: (4, 1), 9: (80, 2)}
    aside = {(r.date.day if r.date else None, r.reason): r.n for r in totals.late_counts(spark, root).collect()}
    assert aside == {(1, "late"): 1, (None, "no_time"): 4}
    open_rows = 1  # day 20
    assert sum(n for _, n in closed.values()) + sum(aside.values()) + open_rows == sum(map(len, batches)) + 4


def test_another_checkpoint_is_refused(spark, tmp_path):
    inbox, root = tmp_path / "in", tmp_path / "out"
    inbox.mkdir()
    drop(inbox, 0)
    feed(spark, inbox, root, tmp_path / "cp")
    before = as_state(tables.sales_state(spark, str(root)))
    for _ in range(2):
        with pytest.raises(uploads.ForeignRoot):
            feed(spark, inbox, root, tmp_path / "cp2")
        assert as_state(tables.sales_state(spark, str(root))) == before
        tables.compact_sales(spark, str(root), 0)
    drop(inbox, 1)
    feed(spark, inbox, root, tmp_path / "cp")
    assert set(counts(spark, root)) == {0, 1}
