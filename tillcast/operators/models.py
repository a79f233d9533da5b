"""Average and trend models, one row per tenant."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from tillcast.constants import (
    AVERAGE_MODEL_NAME,
    AVERAGE_MODEL_VERSION,
    MIN_HISTORY,
    PRIOR_BASE,
    PRIOR_DAILY_STEP,
    PRIOR_DAYS,
    PRIOR_RIPPLE_RATE,
    PRIOR_RIPPLE_SIZE,
    PRIOR_WEEK_SWING,
    RATE,
    RECENT_DAYS,
    TENANT,
)
from tillcast.functions.values import is_number

REAL_SOURCE = "real_pipeline_sales"
PRIOR_SOURCE = "synthetic_fallback"
MISSING_SALES = "missing_sales_data_from_1_data_ingestion"


def numeric_rows(sales: DataFrame, column: str = "daily_sales_total") -> DataFrame:
    floating = isinstance(sales.schema[column].dataType, (DoubleType, FloatType))
    return sales.where(is_number(F.col(column), floating))


def fit_average(sales: DataFrame) -> DataFrame:
    """Average daily sales per tenant, held at four decimals, and the rows behind it."""
    total = F.sum(F.col("daily_sales_total").cast("decimal(18,2)"))
    rows = F.count(F.lit(1))
    return (
        numeric_rows(sales)
        .groupBy(*TENANT)
        .agg(F.round(total / rows, 4).cast(RATE).alias("avg_daily_sales"), rows.alias("training_rows"))
    )


def fit_average_current_or_all(lines: DataFrame) -> DataFrame:
    """Average daily sales per tenant from its current order lines, or from all where it has none.

    ``lines`` has ``date, amount, is_current``; both averages come from one pass.
    """
    amount = F.col("amount").cast("decimal(18,2)")
    current = F.when(F.col("is_current"), amount)
    days = lines.groupBy(*TENANT, "date").agg(F.sum(current).alias("now"), F.sum(amount).alias("all"))

    def average(name: str) -> Column:
        return F.round(F.try_divide(F.sum(name), F.count(name)), 4).cast(RATE)

    return days.groupBy(*TENANT).agg(
        F.coalesce(average("now"), average("all")).alias("avg_daily_sales"), F.count(F.lit(1)).alias("training_rows")
    ).where(F.col("avg_daily_sales").isNotNull())


def tenant_profiles(sales: DataFrame, days: int = RECENT_DAYS, keys: list[str] = TENANT) -> DataFrame:
    """Average model and latest sales of each tenant (or other key) in one pass over the sales table.

    ``sales`` holds one row per key and date, so a window is never longer than the calendar.
    Everything a forecast or a prompt needs is on the key's one row afterwards.
    """
    amount = F.col("daily_sales_total").cast("decimal(18,2)")
    latest = Window.partitionBy(*keys).orderBy(F.col("date").desc())
    ranked = numeric_rows(sales).select(
        *keys, "date", amount.alias("daily_sales_total"), F.row_number().over(latest).alias("rank")
    )
    recent = F.when(F.col("rank") <= days, F.struct("date", "daily_sales_total"))
    rows = F.count(F.lit(1))
    return ranked.groupBy(*keys).agg(
        F.round(F.sum("daily_sales_total") / rows, 4).cast(RATE).alias("avg_daily_sales"),
        rows.alias("training_rows"),
        F.sort_array(F.collect_list(recent)).alias("recent_sales"),
    )


def average_model_records(models: DataFrame, trained_at: Column | None = None) -> DataFrame:
    """The stored form of the average model."""
    return models.select(
        F.lit(AVERAGE_MODEL_NAME).alias("model_name"),
        F.lit(AVERAGE_MODEL_VERSION).alias("version"),
        *TENANT,
        (F.current_timestamp() if trained_at is None else trained_at).alias("trained_at"),
        "avg_daily_sales",
        "training_rows",
    )


def training_outcome(sales: DataFrame) -> DataFrame:
    """Rows seen and average fitted per tenant; the average is NULL without numeric rows."""
    floating = isinstance(sales.schema["daily_sales_total"].dataType, (DoubleType, FloatType))
    usable = is_number(F.col("daily_sales_total"), floating)
    amount = F.when(usable, F.col("daily_sales_total")).cast("decimal(18,2)")
    average = F.try_divide(F.sum(amount), F.count(amount))
    return sales.groupBy(*TENANT).agg(
        F.count(F.lit(1)).alias("sales_rows"), F.round(average, 4).cast(RATE).alias("avg_daily_sales")
    )


def model_status(tenants: DataFrame, outcome: DataFrame) -> DataFrame:
    """What became of each tenant: was a model registered, and can it be used to predict.

    ``outcome`` has one row per tenant with sales, as :func:`training_outcome` gives it; ``tenants``
    may name more.
    """
    known = outcome.select(*TENANT, F.lit(True).alias("found"), "sales_rows", "avg_daily_sales")
    rows = F.coalesce(F.col("sales_rows"), F.lit(0))
    average = F.col("avg_daily_sales")
    return (
        tenants.join(known, TENANT, "left")
        .select(
            *TENANT,
            F.when(rows == 0, F.lit("skipped"))
            .when(average.isNull(), F.lit("error"))
            .otherwise(F.lit("ok"))
            .alias("status"),
            F.when(rows == 0, F.lit(MISSING_SALES))
            .when(average.isNull(), F.lit("no_numeric_sales"))
            .alias("reason"),
            F.when(average.isNull(), F.lit("error")).otherwise(F.lit("ok")).alias("prediction_status"),
            F.when(F.col("found").isNull(), F.lit("model_not_found"))
            .when(average.isNull(), F.lit("invalid_model_format"))
            .alias("prediction_reason"),
        )
    )


def series_index(sales: DataFrame, keys: list[str] = TENANT) -> DataFrame:
    """Position 0..n-1 of each row in its series, by date."""
    tie = [c for c in ("ingest_seq",) if c in sales.columns]
    order = Window.partitionBy(*keys).orderBy("date", *tie)
    return sales.withColumn("x", (F.row_number().over(order) - 1).cast("double"))


def fit_trend(sales: DataFrame, keys: list[str] = TENANT) -> DataFrame:
    """Least-squares line over the series of each key, with the spread of its residuals.

    ``sales`` holds one row per key and date, so a series is never longer than the calendar. The
    index, the line and the spread all work on the same partitioning: one shuffle in total.
    """
    indexed = series_index(
        numeric_rows(sales).withColumn("y", F.col("daily_sales_total").cast("double")), keys
    )
    return _fit(indexed, keys)


def _fit(points: DataFrame, keys: list[str]) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    whole = Window.partitionBy(*keys)
    lined = points.select(
        *keys,
        x,
        y,
        # One point, or no spread in x: a flat line through the mean.
        F.coalesce(F.regr_slope(y, x).over(whole), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(y, x).over(whole), F.avg(y).over(whole)).alias("intercept"),
    )
    residual = y - (F.col("intercept") + F.col("slope") * x)
    return lined.groupBy(*keys).agg(
        F.first("intercept").alias("intercept"),
        F.first("slope").alias("slope"),
        F.stddev_pop(residual).alias("std_error"),
        F.count(F.lit(1)).alias("rows"),
    )


def prior_curve(spark: SparkSession, days: int = PRIOR_DAYS) -> DataFrame:
    """The fixed curve that stands in for a tenant without enough history."""
    i = F.col("id").cast("double")
    week = F.sin((F.col("id") % 7) * F.lit(2 * math.pi) / F.lit(7.0))
    level = (F.lit(PRIOR_BASE) + i * F.lit(PRIOR_DAILY_STEP)) * (F.lit(1.0) + week * F.lit(PRIOR_WEEK_SWING))
    ripple = F.sin(i * F.lit(PRIOR_RIPPLE_RATE)) * F.lit(PRIOR_RIPPLE_SIZE)
    return spark.range(days).select(
        F.lit(PRIOR_SOURCE).alias("training_source"),
        i.alias("x"),
        F.greatest(F.lit(0.0), level + ripple).alias("y"),
    )


def fit_trend_with_prior(tenants: DataFrame, sales: DataFrame, spark: SparkSession) -> DataFrame:
    """Trend per tenant; tenants with too little history take the line of the prior curve."""
    return with_prior(tenants.join(fit_trend(sales), TENANT, "left"), spark)


def with_prior(fitted: DataFrame, spark: SparkSession) -> DataFrame:
    """Tenants with their trend, or the line of the prior curve where there is too little behind it.

    The prior is fitted once and enters as a scalar subquery, so no tenant is multiplied by the days
    of the curve and nothing is joined for it.
    """
    line = ["intercept", "slope", "std_error", "rows"]
    prior = _fit(prior_curve(spark), ["training_source"]).select(F.struct(*line)).scalar()
    cold = F.coalesce(F.col("rows"), F.lit(0)) < MIN_HISTORY
    return fitted.select(
        *TENANT,
        *[F.when(cold, prior.getField(c)).otherwise(F.col(c)).alias(c) for c in line],
        F.when(cold, F.lit(PRIOR_SOURCE)).otherwise(F.lit(REAL_SOURCE)).alias("training_source"),
    )
