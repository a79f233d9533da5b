"""Running daily totals from a stream of order events."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillcast.constants import MONEY, TENANT
from tillcast.functions.values import local_micros
from tillcast.sources.scratch import Scratch
from tillcast.sources.tables import read_batches, write_batch


def daily_totals(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Daily total per tenant from ``restaurant_id, location_id, ts, amount``.

    State is one sum per open tenant day; rows later than ``lateness`` behind the newest event are
    dropped. Works the same on a batch frame, where nothing is late. Event time must be an instant and
    its day windows are cut in UTC, so a wall-clock time is read as UTC and the day taken back from
    there: each row counts for the day on its clock, whatever the session time zone.
    """
    clock = F.timestamp_micros(local_micros(F.col("ts")))
    stamped = events.select(*TENANT, "amount", clock.alias("ts")).withWatermark("ts", lateness)
    day = F.floor(F.unix_micros("day.start") / F.lit(86_400_000_000)).cast("int")
    return (
        stamped.groupBy(*TENANT, F.window("ts", "1 day").alias("day"))
        .agg(F.sum("amount").cast(MONEY).alias("daily_sales_total"))
        .select(*TENANT, F.date_from_unix_date(day).alias("date"), "daily_sales_total")
    )


def write_daily_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each day once it is closed by the watermark."""
    return (
        totals.writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )


DAY_US = 86_400_000_000
SUMS_SCHEMA = "restaurant_id string, location_id string, date date, daily_sales_total decimal(38,2), n bigint, batch_id bigint"


def totals_feed(events: DataFrame, root: str, checkpoint: str, lateness: timedelta = timedelta(days=2)) -> StreamingQuery:
    """Daily totals as tables, with rows that come too late kept beside them.

    A micro-batch adds one sum per tenant and day to ``sums``. A row whose day was closed before its batch goes to ``late``
    with a reason, and so does a row without a time: every row is in a total or there. A day is closed once the
    newest event of earlier batches is ``lateness`` past its end. Batches are directories that a repeat overwrites.
    """
    def apply(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        closed = _closed_until(spark, root, batch_id)
        with Scratch(spark, "totals") as scratch:
            day = F.floor(F.col("us") / F.lit(DAY_US))
            given = rows.select(*TENANT, "ts", "amount", local_micros(F.col("ts")).alias("us"))
            given = scratch.stage(given.withColumn("date", F.date_from_unix_date(day.cast("int"))), "rows")
            late = F.lit(False) if closed is None else (F.unix_date("date").cast("bigint") + 1) * F.lit(DAY_US) <= F.lit(closed)
            reason = F.when(F.col("us").isNull(), F.lit("no_time")).when(late, F.lit("late"))
            aside = given.withColumn("reason", reason)
            write_batch(aside.where(F.col("reason").isNotNull()).drop("us"), f"{root}/late", batch_id)
            sums = aside.where(F.col("reason").isNull()).groupBy(*TENANT, "date").agg(
                F.sum("amount").cast("decimal(38,2)").alias("daily_sales_total"), F.count(F.lit(1)).alias("n"))
            write_batch(sums, f"{root}/sums", batch_id)
            margin = F.lit(lateness // timedelta(microseconds=1))
            write_batch(given.agg((F.max("us") - margin).alias("closed_until")), f"{root}/watermarks", batch_id)

    return events.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _closed_until(spark: SparkSession, root: str, before: int | None = None) -> int | None:
    marks = read_batches(spark, f"{root}/watermarks", "closed_until bigint, batch_id bigint", before)
    return marks.agg(F.max("closed_until")).first()[0]


def closed_totals(spark: SparkSession, root: str) -> DataFrame:
    """The totals of days that are closed, and how many rows are behind each."""
    closed = _closed_until(spark, root)
    sums = read_batches(spark, f"{root}/sums", SUMS_SCHEMA).groupBy(*TENANT, "date").agg(
        F.sum("daily_sales_total").cast(MONEY).alias("daily_sales_total"), F.sum("n").alias("n"))
    if closed is None:
        return sums.limit(0)
    return sums.where((F.unix_date("date").cast("bigint") + 1) * F.lit(DAY_US) <= F.lit(closed))


def late_counts(spark: SparkSession, root: str) -> DataFrame:
    """Rows kept aside, per tenant, date and reason."""
    schema = "restaurant_id string, location_id string, ts timestamp_ntz, amount decimal(18,2), date date, reason string, batch_id bigint"
    return read_batches(spark, f"{root}/late", schema).groupBy(*TENANT, "date", "reason").agg(F.count(F.lit(1)).alias("n"))
