"""Validation of uploaded sales rows, upsert by key and upload counts."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tillcast.constants import DEFAULT_LOCATION_ID, DEFAULT_RESTAURANT_ID, MONEY, SALES_KEY
from tillcast.functions.staging import computed_once
from tillcast.functions.text import first_filled
from tillcast.functions.values import finite, iso_date, number_text


def tenant_columns(
    restaurant: Column,
    location: Column,
    restaurant_arg: Column | None = None,
    location_arg: Column | None = None,
) -> list[Column]:
    """Row value, else the caller's value, else the default; an empty text counts as missing."""
    restaurants = [restaurant] if restaurant_arg is None else [restaurant, restaurant_arg]
    locations = [location] if location_arg is None else [location, location_arg]
    return [
        F.coalesce(first_filled(*restaurants), F.lit(DEFAULT_RESTAURANT_ID)).alias("restaurant_id"),
        F.coalesce(first_filled(*locations), F.lit(DEFAULT_LOCATION_ID)).alias("location_id"),
    ]


def classify_uploads(raw: DataFrame) -> DataFrame:
    """Type every uploaded row and give the first reason it is refused for, if any.

    Expects ``restaurant_id, location_id, date_text, sales_text``; other columns are carried along.
    """
    checked = raw.withColumns(
        {"date": iso_date(F.col("date_text")), "_number": number_text(F.col("sales_text"))}
    )
    number = finite(F.col("_number"))
    amount = F.col("_number").try_cast(MONEY)
    reason = (
        F.when(F.col("date").isNull(), F.lit("invalid_date"))
        .when(number.isNull(), F.lit("invalid_sales"))
        .when(number < 0, F.lit("negative_sales"))
        .when(amount.isNull(), F.lit("invalid_sales"))
    )
    restaurant, location = tenant_columns(F.col("restaurant_id"), F.col("location_id"))
    return computed_once(
        checked,
        [c for c in raw.columns if c not in ("restaurant_id", "location_id")],
        {
            "restaurant_id": restaurant,
            "location_id": location,
            "date": F.col("date"),
            "daily_sales_total": amount,
            "reason": reason,
        },
    )


def accepted_rows(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNull()).drop("reason", "date_text", "sales_text")


def rejected_rows(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("reason").isNotNull()).drop("date", "daily_sales_total")


def arrival_order(rows: DataFrame, batch: str = "batch", seq: str = "ingest_seq") -> Column:
    """One sortable value for (batch, seq).

    Whole numbers are packed into a single decimal: a fixed-width ordering lets Spark keep the
    "latest" aggregate in a hash table. Anything else falls back to a struct.
    """
    types = {f.name: f.dataType for f in rows.schema.fields}
    if isinstance(types[batch], IntegralType) and isinstance(types[seq], IntegralType):
        shift = F.lit(Decimal(10**19))
        return F.col(batch).cast("decimal(18,0)") * shift + F.col(seq).cast("decimal(19,0)")
    return F.struct(batch, seq)


def latest_by_key(
    rows: DataFrame, batch: str = "batch", seq: str = "ingest_seq", keys: list[str] = SALES_KEY
) -> DataFrame:
    """Sales state after applying all rows in arrival order: the last row of a key wins.

    ``max_by`` combines on the map side, so a key repeated any number of times sends one row per
    map task through the shuffle.
    """
    return rows.groupBy(*keys).agg(
        F.max_by("daily_sales_total", arrival_order(rows, batch, seq)).alias("daily_sales_total")
    )


def upsert_sales(current: DataFrame, upload: DataFrame, seq: str = "ingest_seq") -> DataFrame:
    """The current table with the accepted rows of one upload applied.

    ``current`` has one row per key, so its rows need no sequence: they only count where the upload
    has no row for the key.
    """
    incoming = F.col("from_upload")
    both = current.select(
        *SALES_KEY, "daily_sales_total", F.lit(None).cast(upload.schema[seq].dataType).alias(seq),
        F.lit(False).alias("from_upload"),
    ).unionByName(upload.select(*SALES_KEY, "daily_sales_total", seq, F.lit(True).alias("from_upload")))
    uploaded = F.max_by(F.when(incoming, F.col("daily_sales_total")), F.when(incoming, F.col(seq)))
    stored = F.max(F.when(~incoming, F.col("daily_sales_total")))
    return both.groupBy(*SALES_KEY).agg(F.coalesce(uploaded, stored).alias("daily_sales_total"))


def upsert_counts(classified: DataFrame, batch: str = "batch") -> DataFrame:
    """Inserted, updated and skipped rows per batch when the batches are applied in order.

    A key is inserted once, by the first batch that has a valid row for it; every other valid row
    is an update. The rows are read once and counted per key and batch before anything else, with
    all rejects of a batch under one empty key, so a repeated key or a bad batch stays small.
    """
    valid = F.col("reason").isNull()
    per_key = classified.groupBy(
        *[F.when(valid, F.col(c)).alias(c) for c in SALES_KEY], batch, valid.alias("valid")
    ).agg(F.count(F.lit(1)).alias("n"))
    first_batch = F.min(batch).over(Window.partitionBy(*SALES_KEY))
    counted = per_key.select(
        batch, "valid", "n", (F.col("valid") & (F.col(batch) == first_batch)).alias("is_first")
    )
    inserted = F.count_if("is_first")
    return counted.groupBy(batch).agg(
        inserted.alias("inserted"),
        (F.sum(F.when(F.col("valid"), F.col("n")).otherwise(F.lit(0))) - inserted).alias("updated"),
        F.sum(F.when(F.col("valid"), F.lit(0)).otherwise(F.col("n"))).alias("skipped"),
    )


def count_against(current_keys: DataFrame, classified: DataFrame) -> DataFrame:
    """Inserted, updated and skipped rows of one upload against the keys stored so far.

    Stored keys, which may repeat, and uploaded rows meet in one aggregation by key: both combine
    before the shuffle, all rejects under one empty key.
    """
    valid = F.col("reason").isNull()
    uploaded = classified.select(
        *[F.when(valid, F.col(c)).alias(c) for c in SALES_KEY], valid.alias("valid"), F.lit(False).alias("stored")
    )
    stored = current_keys.select(*SALES_KEY, F.lit(None).cast("boolean").alias("valid"), F.lit(True).alias("stored"))
    return _counted(uploaded.unionByName(stored))


def count_batch(classified: DataFrame, is_upload: Column) -> DataFrame:
    """The same for one frame that holds both: rows that are no upload are what the table was made of."""
    valid = F.col("reason").isNull()
    rows = classified.where(is_upload | valid).select(
        *[F.when(valid, F.col(c)).alias(c) for c in SALES_KEY],
        F.when(is_upload, valid).alias("valid"),
        (~is_upload).alias("stored"),
    )
    return _counted(rows)


def _counted(rows: DataFrame) -> DataFrame:
    per_key = rows.groupBy(*SALES_KEY).agg(
        F.bool_or("stored").alias("stored"),
        F.count_if("valid").alias("valid"),
        F.count_if(~F.col("valid")).alias("skipped"),
    )
    total = F.coalesce(F.sum("valid"), F.lit(0))
    inserted = F.count_if((F.col("valid") > 0) & ~F.col("stored"))
    return per_key.agg(
        inserted.alias("inserted"),
        (total - inserted).alias("updated"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
    )


def apply_batch(accepted: DataFrame, is_upload: Column, seq: str = "ingest_seq") -> DataFrame:
    """The table after an upload, from one frame that holds the rows of both."""
    def last(rows: Column) -> Column:
        return F.max_by(F.when(rows, F.col("daily_sales_total")), F.when(rows, F.col(seq)))

    return accepted.groupBy(*SALES_KEY).agg(F.coalesce(last(is_upload), last(~is_upload)).alias("daily_sales_total"))
