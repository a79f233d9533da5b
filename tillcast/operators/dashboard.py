"""The dashboard: forecast, plans and insight of each tenant."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.constants import TENANT
from tillcast.operators.forecast import daily_plan, forecast_days, forecast_path, nest_forecast, with_forecast
from tillcast.operators.insight import ask, build_prompts, parse_answers


def dashboard_days(fc: DataFrame, insight: DataFrame) -> DataFrame:
    """One row per tenant and day."""
    advice = insight.select(*TENANT, "insight_status", "risk_level", F.size("actions").alias("n_actions"))
    return (
        daily_plan(fc)
        .join(advice, TENANT, "left")
        .withColumn("n_actions", F.coalesce("n_actions", F.lit(0)))
    )


def dashboard_from_profiles(
    profiles: DataFrame, provider: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row per tenant and day from tenant profiles.

    Forecast, prompt, answer and plans all follow from the tenant's own row, so nothing is joined
    and nothing is shuffled here. The provider must keep the columns it is given.
    """
    prompts = build_prompts(with_forecast(profiles))
    answered = parse_answers(ask(prompts, provider), "forecast")
    advice = ["insight_status", "risk_level", "n_actions"]
    return daily_plan(
        forecast_days(answered.withColumn("n_actions", F.size("actions")), *advice), *advice
    )


def dashboard_records(forecasts: DataFrame, insight: DataFrame) -> DataFrame:
    """One row per tenant with nested plans, from forecast arrays."""
    advice = insight.select(*TENANT, "insight_status", "insight_json", "risk_level", "actions")
    return (
        nest_forecast(forecasts)
        .join(advice, TENANT, "left")
        .withColumn("actions", F.coalesce("actions", F.array().cast("array<string>")))
    )


def dashboard_from_run(
    profiles: DataFrame,
    forecasts: DataFrame,
    staffing: DataFrame,
    insights: DataFrame,
    provider: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """One row per tenant and day, each part from this run where the tenant has it, else recomputed.

    ``forecasts`` has ``forecast`` arrays, ``staffing`` arrays of ``day_index, recommended_staff`` as
    ``staffing_plan``, ``insights`` what :func:`parse_answers` gives; each may lack any tenant, and an empty array
    counts as missing. A forecast is recomputed from the tenant's profile, a staffing plan from the forecast the
    dashboard shows, and only tenants without an insight are asked about. The inventory always follows the
    forecast. A tenant known to one part alone is kept.
    """
    run_forecast = forecasts.select(*TENANT, F.col("forecast").alias("run_forecast"))
    run_staffing = staffing.select(*TENANT, F.col("staffing_plan").alias("run_staffing"))
    advice = ["insight_status", "risk_level", "n_actions"]
    run_advice = insights.select(*TENANT, F.struct("insight_status", "risk_level", F.size("actions").alias("n_actions")).alias("run_advice"))
    parts = profiles.join(run_forecast, TENANT, "full").join(run_staffing, TENANT, "left").join(run_advice, TENANT, "left")
    present = F.coalesce(F.size("run_forecast") > 0, F.lit(False))
    path = F.when(present, F.col("run_forecast")).otherwise(forecast_path(F.col("avg_daily_sales")))
    parts = parts.withColumn("forecast", path).where(F.col("forecast").isNotNull())

    known = parts.where(F.col("run_advice").isNotNull()).select(*TENANT, "forecast", "run_staffing", *[F.col(f"run_advice.{c}").alias(c) for c in advice])
    unknown = parts.where(F.col("run_advice").isNull())
    answers = ask(build_prompts(unknown), provider)
    if provider is None:
        asked = parse_answers(answers, "forecast", "run_staffing")
    else:  # a provider keeps the tenant of a prompt, and need not keep more
        asked = unknown.select(*TENANT, "forecast", "run_staffing").join(parse_answers(answers), TENANT, "left")
    n_actions = F.coalesce(F.size("actions"), F.lit(0)).alias("n_actions")
    every = known.unionByName(asked.select(*TENANT, "forecast", "run_staffing", "insight_status", "risk_level", n_actions))
    days = forecast_days(every, "run_staffing", *advice)
    planned = F.get(F.filter("run_staffing", lambda d: d["day_index"] == F.col("day_index")), F.lit(0))["recommended_staff"]
    plan = daily_plan(days, "run_staffing", *advice)
    return plan.withColumn("recommended_staff", F.coalesce(planned, F.col("recommended_staff"))).drop("run_staffing")
