"""The whole daily job for all tenants: files in, tables and a run log out.

Each stage writes a table that the next ones read, so a lost executor never costs more than the stage
it worked on, and every stage can be repeated.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.constants import TENANT
from tillcast.operators import features, insight, models
from tillcast.operators.dashboard import dashboard_from_run, dashboard_records
from tillcast.operators.forecast import forecast_days, inventory_plan, staffing_plan, with_forecast
from tillcast.sources.sales_files import dated_file_rows, keyed_file_sales, load_tenant_sales, of_tenants, read_text
from tillcast.sources.scratch import Scratch
from tillcast.sources.tables import (
    append_features,
    append_model_version,
    append_runs,
    read_model_versions,
    trend_model_records,
    write_model_json,
)

STEP_SCHEMA = (
    "run_id string, step string, status string, started_at timestamp, ended_at timestamp, "
    "duration_ms bigint, errors array<string>, warnings array<string>"
)

Provider = Callable[[DataFrame], DataFrame]


class _Steps:
    """Times the stages of one run and collects their envelopes."""

    def __init__(self, run_id: str) -> None:
        self.run_id = run_id
        self.rows: list[tuple] = []

    def ended_well(self, step: str) -> bool:
        return any(row[1] == step and row[2] == "ok" for row in self.rows)

    def run(self, step: str, stage: Callable[[], None], *needs: str) -> None:
        """Run a stage if those it needs ended well in this run; otherwise skip it and say why."""
        started, clock = datetime.now(timezone.utc), time.monotonic()
        missing = [f"needs {n}" for n in needs if not self.ended_well(n)]
        errors: list[str] = []
        if not missing:
            try:
                stage()
            except Exception as e:
                errors.append(f"{type(e).__name__}: {e}")
        took = int((time.monotonic() - clock) * 1000)
        status = "skipped" if missing else "error" if errors else "ok"
        self.rows.append(
            (self.run_id, step, status, started, datetime.now(timezone.utc), took, errors, missing)
        )


def daily_run(
    spark: SparkSession,
    sales_path: str,
    tenants: DataFrame,
    root: str,
    run_id: str,
    version: str,
    inventory: DataFrame | None = None,
    attendance: DataFrame | None = None,
    provider: Provider | None = None,
) -> DataFrame:
    """Run all stages for all tenants and return their envelopes, also kept in the run log.

    Every table is kept by run, and a stage reads tables of its own run only. Where a stage fails,
    those that need it are skipped, and the tables of earlier runs stay as they are.
    """
    steps = _Steps(run_id)

    def table(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}/run_id={run_id}")

    def store(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{name}/run_id={run_id}")

    def ingest() -> None:
        with Scratch(spark, "sales-files") as scratch:
            rows, status = load_tenant_sales(read_text(spark, sales_path, scratch), tenants, scratch)
            store(dated_file_rows(rows), "file_rows")
            dated = table("file_rows")
            store(keyed_file_sales(dated), "file_sales")
            store(dated.where(F.col("reason").isNotNull()), "sales_rejects")
            per_file = dated.groupBy("file_name").agg(
                F.count_if(F.col("reason").isNotNull()).alias("rows_rejected"), F.count_if(F.col("reason").isNull()).alias("rows_used"))
            counts = {c: F.coalesce(c, F.lit(0)) for c in ("rows_rejected", "rows_used")}
            store(of_tenants(status, per_file).withColumns(counts), "sales_status")

    def served() -> DataFrame:
        """Tenants with usable sales, and their file."""
        return table("sales_status").where("rows_used > 0").select(*TENANT, "file_name")

    def warehouse() -> None:
        loaded = {"sales": table("file_sales"), "inventory": inventory, "attendance": attendance}
        store(features.register_tables({k: v for k, v in loaded.items() if v is not None}), "loaded_tables")

    def build_features() -> None:
        store(features.feature_lists(served().select(*TENANT)), "features")

    def sync_features() -> None:
        append_features(features.feature_store_rows(table("features")), f"{root}/feature_store", run_id)

    def register_models() -> None:
        sales = table("file_sales")  # models are fitted once per file, and handed to its tenants
        profiles = of_tenants(served(), models.tenant_profiles(sales, keys=["file_name"]))
        append_model_version(
            profiles.withColumn("model_name", F.lit(models.AVERAGE_MODEL_NAME)),
            f"{root}/average_models",
            version,
        )
        write_model_json(models.average_model_records(this_version("average_models")), f"{root}/average_models_json", version)
        append_model_version(
            trend_model_records(models.with_prior(of_tenants(table("sales_status").select(*TENANT, "file_name"), models.fit_trend(sales, ["file_name"])), spark)),
            f"{root}/trend_models",
            version,
        )

    def this_version(name: str) -> DataFrame:
        return read_model_versions(spark, f"{root}/{name}").where(F.col("model_version") == version).drop("model_version")

    def predict() -> None:
        store(with_forecast(this_version("average_models")), "forecasts")

    def advise() -> None:
        prompts = insight.build_prompts(table("forecasts"))
        answers = insight.ask(prompts, provider).select(*TENANT, "prompt", "status", "reason", "model", "raw_json")
        store(answers, "answers")  # as given, before anything reads them
        parsed = insight.parse_answers(table("answers"))
        # Variants are kept as text in the stored table.
        store(parsed.withColumn("insight_json", F.to_json("insight_json")), "insights")

    def optimise() -> None:
        days = forecast_days(table("forecasts"))
        store(staffing_plan(days), "staffing_plan")
        store(inventory_plan(days), "inventory_plan")

    def part(step: str, name: str, schema: str) -> DataFrame:
        """What a step of this run gave, or nothing where it did not end well."""
        return table(name) if steps.ended_well(step) else spark.createDataFrame([], schema)

    def update_dashboard() -> None:
        ids = "restaurant_id string, location_id string"
        forecasts = part("5_ml_prediction", "forecasts", f"{ids}, forecast array<decimal(18,2)>").select(*TENANT, "forecast")
        staffing = part("6_optimization", "staffing_plan", f"{ids}, day_index int, predicted_sales decimal(18,2), recommended_staff int")
        nested = F.sort_array(F.collect_list(F.struct("day_index", "recommended_staff"))).alias("staffing_plan")
        advice = part("gpt_insight", "insights", f"{ids}, insight_status string, risk_level string, actions array<string>")
        board = dashboard_from_run(this_version("average_models"), forecasts, staffing.groupBy(*TENANT).agg(nested), advice, provider)
        store(board, "dashboard")
        if steps.ended_well("5_ml_prediction") and steps.ended_well("gpt_insight"):
            store(dashboard_records(table("forecasts"), table("insights")), "dashboard_records")

    steps.run("1_data_ingestion", ingest)
    steps.run("2_data_warehouse", warehouse, "1_data_ingestion")
    steps.run("3_feature_engineering", build_features, "1_data_ingestion")
    steps.run("4_feature_store_sync", sync_features, "3_feature_engineering")
    steps.run("model_registry", register_models, "1_data_ingestion")
    steps.run("5_ml_prediction", predict, "model_registry")
    steps.run("gpt_insight", advise, "5_ml_prediction")
    steps.run("6_optimization", optimise, "5_ml_prediction")
    steps.run("8_dashboard_update", update_dashboard, "model_registry")

    envelopes = spark.createDataFrame(steps.rows, STEP_SCHEMA)
    append_runs(envelopes, f"{root}/run_log", run_id)
    return envelopes
