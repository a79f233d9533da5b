from __future__ import annotations

from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from conftest import SAMPLE
from plan_text import formatted, pushed_filters
from tillcast.operators import features, models
from tillcast.sources import tables

T = ("r", "l")
BATCH = "restaurant_id string, location_id string, date date, daily_sales_total decimal(18,2), ingest_seq bigint"


def batch(spark, amounts):
    return spark.createDataFrame(
        [("r", "l", date(2025, 1, d), Decimal(a), i) for i, (d, a) in enumerate(amounts)], BATCH
    )


def state(spark, root, before=None):
    return {r.date.day: int(r.daily_sales_total) for r in tables.sales_state(spark, root, before).collect()}


def test_sales_batches_fold_replay_and_compact(spark, tmp_path):
    root = str(tmp_path)
    assert state(spark, root) == {}
    tables.store_sales_batch(batch(spark, [(1, 10), (2, 20), (1, 11)]), root, 0)
    tables.store_sales_batch(batch(spark, [(2, 21), (3, 30)]), root, 1)
    assert state(spark, root) == {1: 11, 2: 21, 3: 30}
    assert state(spark, root, before=1) == {1: 11, 2: 20}
    tables.store_sales_batch(batch(spark, [(2, 21), (3, 30)]), root, 1)
    assert tables.sales_batches(spark, root).count() == 4
    tables.compact_sales(spark, root, through=1)
    assert tables.sales_batches(spark, root).count() == 3
    tables.store_sales_batch(batch(spark, [(3, 31), (4, 40)]), root, 2)
    assert state(spark, root) == {1: 11, 2: 21, 3: 31, 4: 40}
    tables.compact_sales(spark, root, through=2)
    assert state(spark, root) == {1: 11, 2: 21, 3: 31, 4: 40}
    assert state(spark, root, before=2) == {1: 11, 2: 21, 3: 30}


def test_point_lookup_pushes_its_key(spark, tmp_path):
    root = str(tmp_path)
    tables.store_sales_batch(batch(spark, [(1, 10), (2, 20)]), root, 0)
    found = tables.sales_of_key(spark, root, "r", "l", "2025-01-02")
    assert [int(r.daily_sales_total) for r in found.collect()] == [20]
    pushed = pushed_filters(found)
    assert "EqualTo(restaurant_id,r)" in pushed and "EqualTo(date,2025-01-02)" in pushed


def test_uncommitted_compaction_is_ignored(spark, tmp_path):
    root = str(tmp_path)
    tables.store_sales_batch(batch(spark, [(1, 10)]), root, 0)
    tables.write_batch(batch(spark, [(9, 99)]).drop("ingest_seq"), f"{root}/base", 0)
    assert state(spark, root) == {1: 10}


def test_feature_store(spark, tmp_path):
    tenants = spark.createDataFrame([T], "restaurant_id string, location_id string")
    path = str(tmp_path / "fs")
    tables.append_features(features.feature_store_rows(features.feature_lists(tenants)), path, "run/1")
    tables.append_features(features.feature_store_rows(features.feature_lists(tenants)), path, "run/1")
    tables.append_features(features.feature_store_rows(features.feature_lists(tenants, [])), path, "run/2")
    rows = tables.read_committed(spark, path).collect()
    assert [r.features_json for r in rows] == [
        '["daily_sales_total","hourly_sales_profile","inventory_usage_rate","waste_rate","labor_hours"]'
    ]
    assert rows[0].created_at is not None


def test_model_versions(spark, tmp_path, make_sales):
    path = str(tmp_path / "models")
    first = models.fit_average(make_sales({T: SAMPLE, ("r", "old"): [1]}))
    second = models.fit_average(make_sales({T: [10]}))
    tables.append_model_version(models.average_model_records(first), path, "20250101_000000_aaaaaa")
    tables.append_model_version(models.average_model_records(second), path, "20250102_000000_aaaaaa")
    tables.append_model_version(models.average_model_records(second), path, "20250102_000000_aaaaaa")
    latest = {r.location_id: (float(r.avg_daily_sales), r.model_version) for r in tables.latest_models(spark, path).collect()}
    assert latest == {"l": (10.0, "20250102_000000_aaaaaa"), "old": (1.0, "20250101_000000_aaaaaa")}
    assert tables.read_model_versions(spark, path).count() == 3


def test_trend_versions(spark, tmp_path, make_sales):
    path = str(tmp_path / "trend")
    tables.append_model_version(tables.trend_model_records(models.fit_trend(make_sales({T: SAMPLE}))), path, "v1")
    row = tables.latest_models(spark, path).first()
    assert (row.model_name, row.rows, row.model_version) == ("sales_forecast_pro", 10, "v1")


def test_model_version_text(spark):
    at = F.lit(datetime(2025, 1, 2, 3, 4, 5, tzinfo=timezone.utc))
    df = spark.range(1)
    assert df.select(tables.model_version(at, F.lit("abcdef"))).first()[0] == "20250102_030405_abcdef"
    assert len(df.select(tables.model_version(at)).first()[0]) == 22
    assert df.select(tables.new_run_id(at, F.lit("01234567"))).first()[0] == "run_20250102_030405_01234567"


def test_model_json(spark, tmp_path):
    path = tmp_path / "models.json"
    path.write_text(
        '{"restaurant_id":"r","location_id":"l","version":"1.0","avg_daily_sales":1519.0,"training_rows":10}\n'
        '{"restaurant_id":"r","location_id":"m"}\n[1]\nbroken\n'
    )
    rows = tables.read_model_json(spark, str(path)).collect()
    assert [r.reason for r in rows] == [None, "invalid_model_format", "model_load_failed", "model_load_failed"]
    assert float(rows[0].avg_daily_sales) == 1519.0


def test_run_log_grows_columns(spark, tmp_path):
    path = str(tmp_path / "runs")
    live = spark.createDataFrame([(1, "a", "ok"), (2, "b", None)], "seq bigint, run_id string, status string")
    live = tables.run_payload(live, ["run_id", "status"])
    tables.append_runs(live, path, "a", F.lit("2025-01-01 00:00:00").cast("timestamp"))
    wide = live.limit(1).withColumn("restaurant_id", F.lit("r")).withColumn("location_id", F.lit("l"))
    wide = wide.withColumn("duration_ms", F.lit(None).cast("bigint")).withColumn("payload_json", F.lit("{broken"))
    tables.append_runs(wide, path, "b", F.lit("2025-01-02 00:00:00").cast("timestamp"))
    rows = tables.read_runs(spark, path).orderBy("stored_at", "seq").collect()
    assert [(r.status, r.restaurant_id, r.duration_ms) for r in rows] == [
        ("ok", None, None), ("unknown", None, None), ("ok", "r", 0),
    ]
    assert [r.payload is None for r in rows] == [False, False, True]
    pruned = tables.read_runs(spark, path).where(F.col("stored_day") == F.lit("2025-01-02").cast("date"))
    assert "PartitionFilters: [isnotnull(stored_day" in formatted(pruned) and pruned.count() == 1


def test_model_json_round_trip(spark, tmp_path, make_sales):
    path = str(tmp_path / "json")
    models_ = models.fit_average(make_sales({T: SAMPLE, ("r", "old"): [1]}))
    tables.write_model_json(models.average_model_records(models_), path, "v1")
    tables.write_model_json(models.average_model_records(models_), path, "v1")
    tables.write_model_json(models.average_model_records(models_.where("location_id = 'old'")), path, "v2")
    back = tables.read_model_json(spark, path)
    columns = ["restaurant_id", "location_id", "avg_daily_sales", "training_rows"]
    assert sorted(back.select(columns).collect()) == sorted(models_.select(columns).collect())
    assert {(r.version, r.reason) for r in back.collect()} == {("1.0", None)}


def test_an_append_without_its_commit_is_not_read(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([(1,)], "x int")
    for key in ("007", "a b", "1.0"):
        tables.append_keyed(one, path, key)
    one.write.parquet(f"{path}/rows/appended_by=cut")
    assert sorted(r.appended_by for r in tables.read_committed(spark, path).collect()) == ["007", "1.0", "a b"]
    tables.append_keyed(one.union(one), path, "007")
    assert tables.read_committed(spark, path).where("appended_by = '007'").count() == 2


def test_newest_models_read_no_history(spark, tmp_path, make_sales):
    path = str(tmp_path / "models")
    for version, series in (("v1", {T: [1], ("r", "old"): [2], ("r", "gone"): [3]}), ("v2", {T: [10], ("r", "gone"): [30]}), ("v3", {T: [20]})):
        tables.append_model_version(models.fit_average(make_sales(series)), path, version)
    tables.append_model_version(models.fit_average(make_sales({T: [11]})), path, "v2")  # repeated, without one tenant
    df = tables.latest_models(spark, path)
    assert {r.location_id: (float(r.avg_daily_sales), r.model_version) for r in df.collect()} == {
        "l": (20.0, "v3"), "old": (2.0, "v1"), "gone": (3.0, "v1")}
    assert "/versions" not in formatted(df)
