"""End to end: files in, dashboard and run log out."""

from __future__ import annotations

from conftest import SAMPLE
from test_models import PLAN
import local_provider
from tillcast.operators import insight, runlog
from tillcast.plans.daily_run import daily_run
from tillcast.sources.tables import latest_models, read_committed, read_runs

STEPS = ["1_data_ingestion", "2_data_warehouse", "3_feature_engineering", "4_feature_store_sync",
         "model_registry", "5_ml_prediction", "gpt_insight", "6_optimization", "8_dashboard_update"]


def inputs(spark, folder):
    folder.mkdir()
    lines = [f"2025-01-{i + 1:02d},{a}" for i, a in enumerate(SAMPLE)]
    (folder / "upload_sales.csv").write_text("\n".join(["date,daily_sales_total", *lines]))
    (folder / "r2__l__sales.csv").write_text("daily_sales_total,date\n100,2025-01-01\n")
    return spark.createDataFrame([("restaurant_001", "location_001"), ("r2", "l")], "restaurant_id string, location_id string")


def test_nine_steps_end_ok(spark, tmp_path):
    tenants, root = inputs(spark, tmp_path / "in"), str(tmp_path / "out")
    steps = daily_run(spark, str(tmp_path / "in"), tenants, root, "run_1", "20250101_000000_aaaaaa",
                      provider=local_provider.rule_provider)
    rows = steps.collect()
    assert [r.step for r in rows] == STEPS
    assert [r.errors for r in rows] == [[]] * 9 and all(r.duration_ms >= 0 for r in rows)
    assert read_runs(spark, f"{root}/run_log").count() == 9
    got = runlog.run_summary(steps).first()
    assert (got.ok_count, got.error_count, got.has_errors) == (9, 0, False)

    board = spark.read.parquet(f"{root}/dashboard")
    assert board.count() == 14
    mine = board.where("restaurant_id = 'restaurant_001'").orderBy("day_index").collect()
    assert [(r.day_index, str(r.predicted_sales), r.recommended_staff, str(r.ingredients_needed), str(r.estimated_meals))
            for r in mine] == PLAN
    assert {r.n_actions for r in mine} == {3} and mine[0].risk_level in {"low", "medium", "high"}
    record = spark.read.parquet(f"{root}/dashboard_records").where("restaurant_id = 'r2'").first()
    assert len(record.forecast) == 7 and '"risk_level"' in record.insight_json
    loaded = {r.table_name: r.row_count for r in spark.read.parquet(f"{root}/loaded_tables").collect()}
    assert loaded == {"sales": 11}
    trend = {r.restaurant_id: (r.rows, r.training_source) for r in latest_models(spark, f"{root}/trend_models").collect()}
    assert trend == {"restaurant_001": (10, "real_pipeline_sales"), "r2": (365, "synthetic_fallback")}
    assert read_committed(spark, f"{root}/feature_store").count() == 2


def test_repeat_is_stable_and_external_provider_works(spark, tmp_path):
    tenants, root = inputs(spark, tmp_path / "in"), str(tmp_path / "out")

    def provider(prompts):
        return insight.call_provider(prompts, local_provider.prompt_rule(), parallel=2)

    daily_run(spark, str(tmp_path / "in"), tenants, root, "run_1", "v1", provider=provider)
    first = sorted(spark.read.parquet(f"{root}/dashboard").collect())
    daily_run(spark, str(tmp_path / "in"), tenants, root, "run_1", "v1", provider=provider)
    assert sorted(spark.read.parquet(f"{root}/dashboard").collect()) == first
    daily_run(spark, str(tmp_path / "in"), tenants, root, "run_2", "v1", provider=local_provider.rule_provider)
    second = spark.read.parquet(f"{root}/dashboard").where("run_id = 'run_2'").drop("run_id")
    assert sorted(second.collect()) == sorted(r[:-1] for r in first)
    assert spark.read.parquet(f"{root}/answers").count() == 4
    assert latest_models(spark, f"{root}/average_models").count() == 2
    logged = read_runs(spark, f"{root}/run_log")
    assert {(r.run_id, r.n) for r in logged.groupBy("run_id").count().withColumnRenamed("count", "n").collect()} == {
        ("run_1", 9), ("run_2", 9)}
    assert read_committed(spark, f"{root}/feature_store").count() == 4


def test_failed_stage_is_reported(spark, tmp_path):
    tenants = inputs(spark, tmp_path / "in")
    steps = daily_run(spark, str(tmp_path / "nowhere"), tenants, str(tmp_path / "out"), "run_1", "v1")
    got = runlog.run_summary(steps).first()
    assert got.has_errors and got.ok_count == 0
    assert "PATH_NOT_FOUND" in steps.first().errors[0]


def test_failed_run_leaves_the_last_one_alone(spark, tmp_path):
    tenants, root = inputs(spark, tmp_path / "in"), str(tmp_path / "out")
    daily_run(spark, str(tmp_path / "in"), tenants, root, "run_1", "v1")
    board = sorted(spark.read.parquet(f"{root}/dashboard").collect())
    steps = daily_run(spark, str(tmp_path / "nowhere"), tenants, root, "run_2", "v2").collect()
    assert [r.status for r in steps] == ["error"] + ["skipped"] * 8
    assert steps[5].warnings == ["needs model_registry"]
    assert sorted(spark.read.parquet(f"{root}/dashboard").collect()) == board and {r.run_id for r in board} == {"run_1"}
    assert {r.model_version for r in latest_models(spark, f"{root}/average_models").collect()} == {"v1"}
    assert {r.insight_status for r in board} == {"skipped"}


def test_rows_without_a_date_are_kept_aside(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "upload_sales.csv").write_text("date,daily_sales_total\n2025-01-01,100\nsoon,200\n2025-01-02,200\n,1400\n")
    tenants = spark.createDataFrame([("restaurant_001", "location_001")], "restaurant_id string, location_id string")
    root = str(tmp_path / "out")
    daily_run(spark, str(tmp_path / "in"), tenants, root, "run_1", "v1")
    rejects = spark.read.parquet(f"{root}/sales_rejects").collect()
    assert sorted((r.date_text or "", r.reason) for r in rejects) == [("", "invalid_date"), ("soon", "invalid_date")]
    status = spark.read.parquet(f"{root}/sales_status").first()
    assert (status.sales_rows_loaded, status.rows_rejected) == (4, 2)
    assert status.rows_used == 2
    assert spark.read.parquet(f"{root}/file_sales").count() == status.sales_rows_loaded - status.rows_rejected


def test_a_failed_step_is_made_up_for_by_the_dashboard(spark, tmp_path, monkeypatch):
    tenants, root = inputs(spark, tmp_path / "in"), str(tmp_path / "out")

    def broken(*_):
        raise RuntimeError("no plan")

    monkeypatch.setattr("tillcast.plans.daily_run.staffing_plan", broken)
    steps = {r.step: r.status for r in daily_run(spark, str(tmp_path / "in"), tenants, root, "run_1", "v1",
                                                 provider=local_provider.rule_provider).collect()}
    assert steps["6_optimization"] == "error" and steps["8_dashboard_update"] == "ok"
    board = spark.read.parquet(f"{root}/dashboard").where("restaurant_id = 'restaurant_001'").orderBy("day_index").collect()
    assert [(r.day_index, str(r.predicted_sales), r.recommended_staff, str(r.ingredients_needed), str(r.estimated_meals)) for r in board] == PLAN
