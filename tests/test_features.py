from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from tillcast.operators import features
from tillcast.streaming.totals import daily_totals

T = "restaurant_id string, location_id string"


def test_hourly_profile(spark):
    rows = [("r", "l", datetime(2025, 1, d, h), v) for d, h, v in [(1, 9, 1.0), (2, 9, 2.0), (1, 12, 5.0)]]
    rows += [("r", "zero", datetime(2025, 1, 1, 9), 0.0)]
    df = spark.createDataFrame(rows, T + ", ts timestamp_ntz, value double")
    got = {(r.location_id, r.hour): r.share for r in features.hourly_profile(df).collect()}
    assert got == {("l", 9): 0.375, ("l", 12): 0.625, ("zero", 9): None}


def test_usage_and_waste(spark):
    rows = [(1, date(2025, 1, 1), 4.0, 1.0), (1, date(2025, 1, 1), 2.0, 0.0), (1, date(2025, 1, 3), 4.0, 1.5),
            (2, date(2025, 1, 1), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "item_id bigint, date date, handled_qty double, wasted_qty double")
    assert {tuple(r) for r in features.usage_rate(df).collect()} == {(1, 5.0), (2, 0.0)}
    assert {tuple(r) for r in features.waste_rate(df).collect()} == {(1, 0.25), (2, None)}


def test_labor_hours_in_any_time_zone(spark):
    # 2025-03-09 has a clock change in New York; wall-clock times do not.
    rows = [(1, date(2025, 3, 9), datetime(2025, 3, 9, 1, 30), datetime(2025, 3, 9, 4, 0)),
            (1, date(2025, 3, 9), datetime(2025, 3, 9, 20, 0), datetime(2025, 3, 10, 0, 15, 0, 500000)),
            (2, date(2025, 3, 9), datetime(2025, 3, 9, 1, 0), datetime(2025, 3, 9, 1, 0))]
    df = spark.createDataFrame(rows, "employee_id bigint, work_date date, clock_in timestamp_ntz, clock_out timestamp_ntz")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = {r.employee_id: r.labor_hours for r in features.labor_hours(df).collect()}
            assert got == {1: round(2.5 + 4.25 + 0.5 / 3600, 6), 2: 0.0}
            late = df.select(
                F.lit("r").alias("restaurant_id"), F.lit("l").alias("location_id"), F.col("clock_out").alias("ts"),
                F.lit(1).cast("decimal(18,2)").alias("amount"),
            )
            days = {str(r.date): int(r.daily_sales_total) for r in daily_totals(late).collect()}
            assert days == {"2025-03-09": 2, "2025-03-10": 1}
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_registered_tables_answer_sql(spark, make_sales):
    sales = make_sales({("r", "l"): [1, 2, 3]})
    counts = features.register_tables({"sales": sales, "inventory": sales.limit(0)})
    assert {tuple(r) for r in counts.collect()} == {("sales", 3), ("inventory", 0)}
    assert int(spark.sql("select sum(daily_sales_total) s from sales").first().s) == 6


def test_daily_sales_sums_exactly(spark):
    df = spark.range(1000).select(
        F.lit("r").alias("restaurant_id"), F.lit("l").alias("location_id"), F.lit(date(2025, 1, 1)).alias("date"),
        F.lit("0.10").cast("decimal(18,2)").alias("amount"),
    )
    assert str(features.daily_sales(df).first().daily_sales_total) == "100.00"
