"""Sales, inventory, waste and labour features, and the feature list kept per tenant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillcast.constants import FEATURE_NAMES, MONEY, SALES_KEY, TENANT
from tillcast.functions.values import local_micros


def daily_sales(order_lines: DataFrame) -> DataFrame:
    """Daily total per tenant from ``restaurant_id, location_id, date, amount``."""
    return order_lines.groupBy(*SALES_KEY).agg(
        F.sum("amount").cast(MONEY).alias("daily_sales_total")
    )


def hourly_profile(events: DataFrame) -> DataFrame:
    """Share of a tenant's value that falls into each hour of the day.

    Events are read once and summed by hour first, so the window over a tenant has at most 24 rows
    however many events it has.
    """
    hourly = events.groupBy(*TENANT, F.hour("ts").alias("hour")).agg(F.sum("value").alias("value"))
    total = F.sum("value").over(Window.partitionBy(*TENANT))
    share = F.try_divide(F.col("value"), total)
    return hourly.select(*TENANT, "hour", F.round(share, 6).alias("share"))


def usage_rate(inventory: DataFrame) -> DataFrame:
    """Used quantity per active day of an item."""
    return (
        inventory.groupBy("item_id", "date")
        .agg(F.sum("handled_qty").alias("used"))
        .groupBy("item_id")
        .agg(F.round(F.sum("used") / F.count(F.lit(1)), 6).alias("usage_rate"))
    )


def waste_rate(inventory: DataFrame) -> DataFrame:
    """Wasted share of the handled quantity; NULL where nothing was handled."""
    rate = F.try_divide(F.sum("wasted_qty"), F.sum("handled_qty"))
    return inventory.groupBy("item_id").agg(F.round(rate, 6).alias("waste_rate"))


def labor_hours(attendance: DataFrame) -> DataFrame:
    """Hours between clock-in and clock-out, summed per person and day."""
    micros = local_micros(F.col("clock_out")) - local_micros(F.col("clock_in"))
    return attendance.groupBy("employee_id", "work_date").agg(
        F.round(F.sum(micros) / F.lit(3_600_000_000), 6).alias("labor_hours")
    )


def feature_lists(tenants: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The generated feature names of each tenant as an array."""
    kept = F.array(*[F.lit(n) for n in (FEATURE_NAMES if names is None else names)])
    return tenants.select(*TENANT, kept.cast("array<string>").alias("features"))


def feature_store_rows(lists: DataFrame) -> DataFrame:
    """Rows for the feature store; a tenant with an empty list gets none."""
    return lists.where(F.size("features") > 0).select(
        *TENANT, F.to_json("features").alias("features_json")
    )


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per loaded table with its row count."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


def register_tables(tables: dict[str, DataFrame]) -> DataFrame:
    """Make the tables available to SQL under their names and report what was loaded."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return table_counts(tables)
