"""Forecast and the staffing and inventory plans derived from it."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.constants import (
    DAILY_GROWTH,
    HORIZON_DAYS,
    INGREDIENT_RATIO,
    MEAL_PRICE,
    MONEY,
    RATE,
    SALES_PER_STAFF,
    TENANT,
)

DAY = [*TENANT, "day_index"]


def forecast_path(start: Column, horizon: int = HORIZON_DAYS, growth: Decimal = DAILY_GROWTH) -> Column:
    """Amounts of the coming days as an array; each day grows the rounded day before it."""
    factor = F.lit(Decimal(1) + Decimal(growth))

    def next_day(path: Column, _: Column) -> Column:
        return F.concat(path, F.array(F.round(F.element_at(path, -1) * factor, 2).cast(RATE)))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.array(start.cast(RATE)), next_day)
    return F.slice(path, 2, horizon).cast(f"array<{MONEY}>")


def next_day_prediction(models: DataFrame, growth: Decimal = DAILY_GROWTH) -> DataFrame:
    amount = F.round(F.col("avg_daily_sales").cast(RATE) * F.lit(Decimal(1) + Decimal(growth)), 2)
    return models.where(F.col("avg_daily_sales").isNotNull()).select(
        *TENANT, amount.cast(MONEY).alias("predicted_next_day_sales")
    )


def with_forecast(models: DataFrame, horizon: int = HORIZON_DAYS, growth: Decimal = DAILY_GROWTH) -> DataFrame:
    """Adds the whole forecast of a tenant as an array; tenants without an average drop out."""
    return models.where(F.col("avg_daily_sales").isNotNull()).withColumn(
        "forecast", forecast_path(F.col("avg_daily_sales"), horizon, growth)
    )


def forecast(models: DataFrame, horizon: int = HORIZON_DAYS, growth: Decimal = DAILY_GROWTH) -> DataFrame:
    """One row per tenant and coming day; a row-local expansion, so no shuffle."""
    return forecast_days(with_forecast(models, horizon, growth))


def forecast_days(forecasts: DataFrame, *keep: str) -> DataFrame:
    """Forecast arrays as rows, with further columns carried along.

    The outer form gives the same rows, as a forecast is never empty, and spares the size filter
    Spark would derive from a plain explode by computing the forecast a second time.
    """
    return forecasts.select(
        *TENANT, *keep, F.posexplode_outer("forecast").alias("pos", "predicted_sales")
    ).select(*TENANT, (F.col("pos") + 1).alias("day_index"), "predicted_sales", *keep)


def staff_needed(predicted: Column, sales_per_staff: int = SALES_PER_STAFF) -> Column:
    whole = F.floor(predicted / F.lit(sales_per_staff)).cast("int")
    return F.when(predicted <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), whole))


def ingredients_needed(predicted: Column, ratio: Decimal = INGREDIENT_RATIO) -> Column:
    return F.round(predicted * F.lit(ratio), 2).cast(MONEY)


def estimated_meals(predicted: Column, meal_price: int = MEAL_PRICE) -> Column:
    return F.round(predicted / F.lit(meal_price), 2).cast(MONEY)


def staffing_plan(fc: DataFrame, sales_per_staff: int = SALES_PER_STAFF) -> DataFrame:
    return fc.select(
        *DAY,
        "predicted_sales",
        staff_needed(F.col("predicted_sales"), sales_per_staff).alias("recommended_staff"),
    )


def inventory_plan(fc: DataFrame, cost_ratio: Decimal = INGREDIENT_RATIO, meal_price: int = MEAL_PRICE) -> DataFrame:
    return fc.select(
        *DAY,
        "predicted_sales",
        ingredients_needed(F.col("predicted_sales"), cost_ratio).alias("ingredients_needed"),
        estimated_meals(F.col("predicted_sales"), meal_price).alias("estimated_meals"),
    )


def daily_plan(fc: DataFrame, *keep: str) -> DataFrame:
    """Forecast, staffing and inventory in one projection, with further columns carried along."""
    amount = F.col("predicted_sales")
    return fc.select(
        *DAY,
        amount,
        staff_needed(amount).alias("recommended_staff"),
        ingredients_needed(amount).alias("ingredients_needed"),
        estimated_meals(amount).alias("estimated_meals"),
        *keep,
    )


def join_plans(fc: DataFrame, staffing: DataFrame, inventory: DataFrame) -> DataFrame:
    """The same from separately stored plans, matched on tenant and day."""
    return (
        fc.select(*DAY, "predicted_sales")
        .join(staffing.drop("predicted_sales"), DAY)
        .join(inventory.drop("predicted_sales"), DAY)
    )


def nest_plans(plan: DataFrame) -> DataFrame:
    """One row per tenant with the plans as ordered arrays, one entry per day of the horizon."""

    def nested(*columns: str) -> Column:
        return F.sort_array(F.collect_list(F.struct("day_index", *columns)))

    return plan.groupBy(*TENANT).agg(
        F.transform(nested("predicted_sales"), lambda d: d["predicted_sales"]).alias("forecast"),
        nested("predicted_sales", "recommended_staff").alias("staffing_plan"),
        nested("predicted_sales", "ingredients_needed", "estimated_meals").alias("inventory_plan"),
    )


def nest_forecast(arrays: DataFrame) -> DataFrame:
    """The same nested plans straight from the forecast array: row-local, without a shuffle."""
    staffing = F.transform(
        "forecast",
        lambda amount, pos: F.struct(
            (pos + 1).alias("day_index"),
            amount.alias("predicted_sales"),
            staff_needed(amount).alias("recommended_staff"),
        ),
    )
    inventory = F.transform(
        "forecast",
        lambda amount, pos: F.struct(
            (pos + 1).alias("day_index"),
            amount.alias("predicted_sales"),
            ingredients_needed(amount).alias("ingredients_needed"),
            estimated_meals(amount).alias("estimated_meals"),
        ),
    )
    return arrays.select(
        *TENANT, "forecast", staffing.alias("staffing_plan"), inventory.alias("inventory_plan")
    )
