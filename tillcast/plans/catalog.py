"""The registered queries. Each takes ``(spark, sf_dir)`` and reads the given tables whole.

Decimals become doubles and dates ISO text in the last projection, so that results compare equal
across engines; everything before that stays typed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.constants import DEFAULT_LOCATION_ID, DEFAULT_RESTAURANT_ID, MONEY, TENANT
from tillcast.functions import payload
from tillcast.functions.text import stripped_or
from tillcast.functions.values import finite_number, money
from tillcast.operators import envelope, features, insight, models, requests, runlog
from tillcast.operators.dashboard import dashboard_from_profiles, dashboard_from_run
from tillcast.operators.forecast import (
    DAY,
    daily_plan,
    forecast,
    inventory_plan,
    join_plans,
    nest_plans,
    next_day_prediction,
    staffing_plan,
    with_forecast,
)
from tillcast.operators.ingest import (
    accepted_rows,
    apply_batch,
    classify_uploads,
    count_batch,
    latest_by_key,
    upsert_counts,
)
from tillcast.sources import testbed
from tillcast.sources.logs import parse_log_lines
from tillcast.sources.sales_files import file_verdicts, of_tenants, resolve_tenant_files
from tillcast.streaming.totals import daily_totals

Query = Callable[[SparkSession, str], DataFrame]


def _double(name: str, digits: int | None = None) -> Column:
    value = F.col(name).cast("double")
    return (value if digits is None else F.round(value, digits)).alias(name)


def _text(name: str) -> Column:
    return F.col(name).cast("string").alias(name)


def daily_sales(spark: SparkSession, sf: str) -> DataFrame:
    return testbed.sales(spark, sf).select(*TENANT, _text("date"), _double("daily_sales_total"))


def upload_validation(spark: SparkSession, sf: str) -> DataFrame:
    return classify_uploads(testbed.raw_upload(spark, sf)).select("upload_id", "reason")


def upload_rejects(spark: SparkSession, sf: str) -> DataFrame:
    counted = classify_uploads(testbed.raw_upload(spark, sf)).where(F.col("reason").isNotNull())
    return counted.groupBy(*TENANT, "reason").agg(F.count(F.lit(1)).alias("n"))


def upload_file_verdict(spark: SparkSession, sf: str) -> DataFrame:
    rows = testbed.upload_files(spark, sf).select(
        "file_name",
        money(F.col("sales_text")).alias("daily_sales_total"),
        finite_number(F.col("sales_text")).isNotNull().alias("valid"),
    )
    return file_verdicts(rows)


def upload_upsert(spark: SparkSession, sf: str) -> DataFrame:
    accepted = accepted_rows(classify_uploads(testbed.raw_upload(spark, sf)))
    return latest_by_key(accepted, seq="upload_id").select(
        *TENANT, _text("date"), _double("daily_sales_total")
    )


def upload_counts(spark: SparkSession, sf: str) -> DataFrame:
    return upsert_counts(classify_uploads(testbed.raw_upload(spark, sf)))


def upload_against_table(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of batch 1 against the keys that batch 0 left in the table."""
    return count_batch(classify_uploads(testbed.raw_upload(spark, sf)), F.col("batch") == 1)


def upload_applied_to_table(spark: SparkSession, sf: str) -> DataFrame:
    """The table of batch 0 with batch 1 applied to it."""
    accepted = accepted_rows(classify_uploads(testbed.raw_upload(spark, sf)))
    return apply_batch(accepted, F.col("batch") == 1, seq="upload_id").select(
        *TENANT, _text("date"), _double("daily_sales_total")
    )


def running_daily_totals(spark: SparkSession, sf: str) -> DataFrame:
    """The streaming aggregation on a batch frame."""
    events = testbed.tenant_events(spark, sf).select(
        *TENANT, "ts", F.col("value").cast(MONEY).alias("amount")
    )
    return daily_totals(events).select(*TENANT, _text("date"), _double("daily_sales_total"))


def tenant_file_resolution(spark: SparkSession, sf: str) -> DataFrame:
    return resolve_tenant_files(testbed.tenants(spark, sf), testbed.sales_files(spark, sf))


def warehouse_tables(spark: SparkSession, sf: str) -> DataFrame:
    return features.table_counts(
        {
            "sales": testbed.sales(spark, sf),
            "inventory": testbed.inventory(spark, sf),
            "attendance": testbed.attendance(spark, sf),
        }
    )


def hourly_sales_profile(spark: SparkSession, sf: str) -> DataFrame:
    return features.hourly_profile(testbed.tenant_events(spark, sf))


def inventory_usage_rate(spark: SparkSession, sf: str) -> DataFrame:
    return features.usage_rate(testbed.stock_movements(spark, sf)).withColumnRenamed(
        "item_id", "part_key"
    )


def waste_rate(spark: SparkSession, sf: str) -> DataFrame:
    return features.waste_rate(testbed.stock_movements(spark, sf)).withColumnRenamed(
        "item_id", "part_key"
    )


def labor_hours(spark: SparkSession, sf: str) -> DataFrame:
    return features.labor_hours(testbed.attendance(spark, sf)).select(
        F.col("employee_id").alias("user_id"),
        F.col("work_date").cast("string").alias("date"),
        "labor_hours",
    )


def feature_store(spark: SparkSession, sf: str) -> DataFrame:
    return features.feature_store_rows(features.feature_lists(testbed.sales_tenants(spark, sf)))


def avg_model(spark: SparkSession, sf: str) -> DataFrame:
    return models.fit_average(testbed.sales(spark, sf)).select(
        *TENANT, _double("avg_daily_sales"), "training_rows"
    )


def model_status(spark: SparkSession, sf: str) -> DataFrame:
    outcome = models.training_outcome(testbed.single_sales(spark, sf))
    return models.model_status(testbed.single_tenants(spark, sf), outcome)


def next_day(spark: SparkSession, sf: str) -> DataFrame:
    return next_day_prediction(models.fit_average(testbed.sales(spark, sf))).select(
        *TENANT, _double("predicted_next_day_sales")
    )


def trend_model(spark: SparkSession, sf: str) -> DataFrame:
    return models.fit_trend(testbed.sales(spark, sf)).where(
        F.col("rows") >= models.MIN_HISTORY
    ).select(*TENANT, _double("intercept", 4), _double("slope", 4), _double("std_error", 4), "rows")


def trend_model_cold_start(spark: SparkSession, sf: str) -> DataFrame:
    fitted = models.fit_trend_with_prior(
        testbed.single_tenants(spark, sf), testbed.single_sales(spark, sf), spark
    )
    # Short series end in exact halves of the last digit; the small step takes them off the edge.
    def rounded(name: str) -> Column:
        return F.round(F.col(name) + 1e-6, 4).alias(name)

    return fitted.select(
        *TENANT,
        rounded("intercept"),
        rounded("slope"),
        rounded("std_error"),
        "rows",
        "training_source",
    )


def _forecast(spark: SparkSession, sf: str) -> DataFrame:
    return forecast(models.fit_average(testbed.sales(spark, sf)))


def forecast_7d(spark: SparkSession, sf: str) -> DataFrame:
    return _forecast(spark, sf).select(*TENANT, "day_index", _double("predicted_sales"))


def staffing(spark: SparkSession, sf: str) -> DataFrame:
    return staffing_plan(_forecast(spark, sf)).select(
        *TENANT, "day_index", _double("predicted_sales"), "recommended_staff"
    )


def inventory(spark: SparkSession, sf: str) -> DataFrame:
    return inventory_plan(_forecast(spark, sf)).select(
        *TENANT,
        "day_index",
        _double("predicted_sales"),
        _double("ingredients_needed"),
        _double("estimated_meals"),
    )


def plans_joined(spark: SparkSession, sf: str) -> DataFrame:
    fc = _forecast(spark, sf)
    return join_plans(fc, staffing_plan(fc), inventory_plan(fc)).select(
        *TENANT,
        "day_index",
        _double("predicted_sales"),
        "recommended_staff",
        _double("ingredients_needed"),
        _double("estimated_meals"),
    )


def nested_plans(spark: SparkSession, sf: str) -> DataFrame:
    return nest_plans(daily_plan(_forecast(spark, sf))).select(
        *TENANT,
        *[F.to_json(c).alias(c) for c in ("forecast", "staffing_plan", "inventory_plan")],
    )


def forecast_current_or_recomputed(spark: SparkSession, sf: str) -> DataFrame:
    """The forecast of a tenant's current sales where it has any, else that of all its sales."""
    fitted = models.fit_average_current_or_all(testbed.single_order_lines(spark, sf))
    return forecast(fitted).select(*DAY, _double("predicted_sales"))


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return insight.build_prompts(with_forecast(models.tenant_profiles(testbed.sales(spark, sf))))


def dashboard(spark: SparkSession, sf: str) -> DataFrame:
    profiles = models.tenant_profiles(testbed.sales(spark, sf))
    return dashboard_from_profiles(profiles).select(
        *TENANT,
        "day_index",
        _double("predicted_sales"),
        "recommended_staff",
        _double("ingredients_needed"),
        _double("estimated_meals"),
        "insight_status",
        "risk_level",
        "n_actions",
    )


def recent_sales(spark: SparkSession, sf: str) -> DataFrame:
    return insight.recent_sales(testbed.sales(spark, sf)).select(
        *TENANT, _text("date"), _double("daily_sales_total")
    )


def insight_prompt(spark: SparkSession, sf: str) -> DataFrame:
    return _prompts(spark, sf).select(
        *TENANT, "prompt", insight.prompt_preview(F.col("prompt")).alias("prompt_preview")
    )


def insight_skipped(spark: SparkSession, sf: str) -> DataFrame:
    """Every tenant without a provider."""
    return insight.parse_answers(insight.ask(_prompts(spark, sf))).select(
        *TENANT, "insight_status", "reason", "prompt_preview", F.size("actions").alias("n_actions")
    )


def insight_context(spark: SparkSession, sf: str) -> DataFrame:
    contexts = testbed.run_contexts(spark, sf)
    parsed = contexts.withColumn("context", payload.parsed(F.col("context_json")))
    return _context_digest(insight.read_contexts(parsed, "context", "seq"))


def _context_digest(contexts: DataFrame) -> DataFrame:
    return contexts.select(
        "seq", *TENANT, "horizon", "model_used", F.size("forecast").alias("n_forecast"),
        F.size("recent_sales").alias("n_recent"),
    )


def insight_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Answers as given: objects, other JSON, broken text, none, errors and skips."""
    return insight.parse_answers(testbed.given_answers(spark, sf), "seq").select(
        "seq", *TENANT, "insight_status", "model", "reason", "risk_level", F.array_join("actions", ",").alias("actions"),
        F.array_join(F.transform("warnings", lambda w: w["message"]), ",").alias("warning"),
    )


def insight_parse(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("payload")
    return runlog.decode_payload(testbed.run_log(spark, sf)).select(
        "seq",
        payload.verdict(value).alias("verdict"),
        payload.field(payload.object_or_null(value), "$.k").alias("k"),
    )


def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.run_summary(testbed.run_log(spark, sf))


def latest_run(spark: SparkSession, sf: str) -> DataFrame:
    runs = testbed.tenant_runs(spark, sf).select(*TENANT, "seq", "run_id", "status", "payload_json")
    latest = runlog.decode_payload(runlog.latest_run_per_tenant(runs))
    return latest.select(
        *TENANT, "run_id", "status", F.col("payload").isNotNull().alias("payload_ok")
    )


def latest_run_overall(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.latest_run(testbed.tenant_runs(spark, sf)).select(*TENANT, "run_id", "status")


def runs_of_one_tenant(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of one tenant, with the defaults of ids, status and duration where those are missing."""
    seq = F.col("seq")
    runs = testbed.tenant_runs(spark, sf).withColumns({
        "restaurant_id": stripped_or(F.when(seq % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), "restaurant_id")), DEFAULT_RESTAURANT_ID),
        "location_id": stripped_or(F.col("location_id"), DEFAULT_LOCATION_ID),
        "status": F.when(seq % 9 == 1, F.lit("")).when(seq % 9 != 0, F.col("status")),
        "duration_ms": F.when(seq % 4 != 0, F.col("duration_ms")),
    })
    found = runlog.runs_of_tenant(runlog.with_run_defaults(runs), "restaurant_1", "location_1")
    return found.select("seq", "run_id", "status", "duration_ms")


def run_tenants(spark: SparkSession, sf: str) -> DataFrame:
    decoded = runlog.decode_payload(testbed.wrapped_runs(spark, sf))
    return runlog.run_tenants(decoded).select("run_id", *TENANT)


def run_sales_extract(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.extract_sales(testbed.raw_runs(spark, sf)).select(
        "run_id", "date", _double("daily_sales_total")
    )


def latest_run_sales(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.sales_of_latest_run(testbed.raw_runs(spark, sf), strict=False).select(
        *TENANT, "date", _double("daily_sales_total")
    )


def run_request_audit(spark: SparkSession, sf: str) -> DataFrame:
    audited = requests.audit_requests(testbed.run_requests(spark, sf), testbed.REQUEST_STEPS)
    return audited.select(
        "request_id",
        F.array_join("plan", ",").alias("plan"),
        F.array_join("unknown_steps", ",").alias("unknown_steps"),
        F.array_join("unknown_selectors", ",").alias("unknown_selectors"),
        "verdict",
        "steps_planned",
    )


def unknown_step_counts(spark: SparkSession, sf: str) -> DataFrame:
    known = testbed.table(spark, sf, "events").select(F.col("event_type").alias("step")).distinct()
    return requests.unknown_step_counts(testbed.run_requests(spark, sf), known)


def known_step_counts(spark: SparkSession, sf: str) -> DataFrame:
    known = testbed.table(spark, sf, "events").select(F.col("event_type").alias("step")).distinct()
    return requests.known_step_counts(testbed.run_requests(spark, sf), known)


def step_durations(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.step_durations(parse_log_lines(testbed.log_lines(spark, sf))).select(
        "step", "runs", "avg_ms", "max_ms", F.round("p95_ms", 6).alias("p95_ms")
    )


def step_output_normalise(spark: SparkSession, sf: str) -> DataFrame:
    shaped = envelope.with_status(testbed.step_output(spark, sf)).select(
        "step_id",
        "errors",
        "warnings",
        F.col("status").alias("plain_status"),
        F.size("errors").alias("n_errors"),
        F.size("warnings").alias("n_warnings"),
    )
    return envelope.demote_errors(shaped, F.lit(True)).select(
        "step_id",
        F.col("plain_status").alias("status"),
        "n_errors",
        "n_warnings",
        F.col("status").alias("demoted_status"),
        F.size("warnings").alias("demoted_warnings"),
    )


def step_payload_coerce(spark: SparkSession, sf: str) -> DataFrame:
    coerced = envelope.coerce_output(testbed.raw_outputs(spark, sf))
    return coerced.select("seq", "data_json", "status", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"), "metrics_json")


def dashboard_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The dashboard of a run that has some parts of some tenants."""
    profiles = models.tenant_profiles(testbed.sales(spark, sf))
    return dashboard_from_run(profiles, *testbed.run_parts(profiles)).select(
        *DAY, _double("predicted_sales"), "recommended_staff", _double("ingredients_needed"), _double("estimated_meals"),
        "insight_status", "risk_level", "n_actions")


def file_models(spark: SparkSession, sf: str) -> DataFrame:
    """Models fitted once per sales file and handed to the tenants of the file."""
    sales = testbed.file_sales(spark, sf)
    resolved = resolve_tenant_files(testbed.tenants(spark, sf), sales.select("file_name").distinct())
    fitted = models.tenant_profiles(sales, keys=["file_name"]).select("file_name", "avg_daily_sales", "training_rows")
    fitted = fitted.join(models.fit_trend(sales, ["file_name"]).drop("rows"), "file_name")
    return of_tenants(resolved, fitted).select(
        *TENANT, "file_name", _double("avg_daily_sales"), "training_rows", _double("slope", 4), _double("intercept", 4))


def stored_run_average(spark: SparkSession, sf: str) -> DataFrame:
    """The average model from the newest stored run of each tenant with usable sales."""
    return models.fit_average(runlog.latest_stored_sales(testbed.raw_runs(spark, sf))).select(*TENANT, _double("avg_daily_sales"), "training_rows")


def stored_run_trend(spark: SparkSession, sf: str) -> DataFrame:
    """The trend model from the same, with entries that are no objects left out of a run."""
    sales = runlog.latest_stored_sales(testbed.raw_runs(spark, sf), strict=False)
    return models.fit_trend(sales).select(*TENANT, _double("intercept", 4), _double("slope", 4), _double("std_error", 4), "rows")


QUERIES: dict[str, Query] = {
    "daily_sales": daily_sales,
    "upload_validation": upload_validation,
    "upload_rejects": upload_rejects,
    "upload_file_verdict": upload_file_verdict,
    "upload_upsert": upload_upsert,
    "upload_counts": upload_counts,
    "upload_against_table": upload_against_table,
    "upload_applied_to_table": upload_applied_to_table,
    "running_daily_totals": running_daily_totals,
    "tenant_file_resolution": tenant_file_resolution,
    "warehouse_tables": warehouse_tables,
    "hourly_sales_profile": hourly_sales_profile,
    "inventory_usage_rate": inventory_usage_rate,
    "waste_rate": waste_rate,
    "labor_hours": labor_hours,
    "feature_store": feature_store,
    "avg_model": avg_model,
    "model_status": model_status,
    "next_day_prediction": next_day,
    "trend_model": trend_model,
    "trend_model_cold_start": trend_model_cold_start,
    "forecast_7d": forecast_7d,
    "staffing_plan": staffing,
    "inventory_plan": inventory,
    "plans_joined": plans_joined,
    "nested_plans": nested_plans,
    "forecast_current_or_recomputed": forecast_current_or_recomputed,
    "dashboard": dashboard,
    "recent_sales": recent_sales,
    "insight_prompt": insight_prompt,
    "insight_skipped": insight_skipped,
    "insight_context": insight_context,
    "insight_answers": insight_answers,
    "insight_parse": insight_parse,
    "run_summary": run_summary,
    "latest_run": latest_run,
    "latest_run_overall": latest_run_overall,
    "runs_of_one_tenant": runs_of_one_tenant,
    "run_tenants": run_tenants,
    "run_sales_extract": run_sales_extract,
    "latest_run_sales": latest_run_sales,
    "run_request_audit": run_request_audit,
    "unknown_step_counts": unknown_step_counts,
    "known_step_counts": known_step_counts,
    "step_durations": step_durations,
    "step_output_normalise": step_output_normalise,
    "step_payload_coerce": step_payload_coerce,
    "dashboard_parts": dashboard_parts,
    "file_models": file_models,
    "stored_run_average": stored_run_average,
    "stored_run_trend": stored_run_trend,
}
