"""Readers for the two log line formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.functions.staging import computed_once
from tillcast.functions.text import filled

JSON_LOG_FIELDS = {
    "ts": "string", "level": "string", "logger": "string", "event": "string", "message": "string", "run_id": "string",
    "step": "string", "status": "string", "duration_ms": "bigint",
}
TEXT_LOG_FIELDS = ["event", "run_id", "step", "status", "reason", "error_type"]


def log_field(line: Column, key: str) -> Column:
    """One ``key=value`` of a log line, or NULL. The first of a repeated key counts.

    A value goes on to the next `` key=`` or the end of the line, so it may hold blanks.
    """
    after = F.split_part(line, F.lit(f" {key}="), F.lit(2))
    return filled(F.regexp_replace(after, r" [A-Za-z_][A-Za-z0-9_]*=[\s\S]*$", ""))


def parse_log_lines(lines: DataFrame) -> DataFrame:
    """Columns of ``[time] event=… run_id=… step=… key=value …`` lines held in ``value``.

    Every line is kept, whole, in ``line``; one without an event has ``parsed`` false and no fields.
    """
    line = F.col("value")
    return lines.select(
        F.when(line.startswith("["), F.substring_index(F.substr(line, F.lit(2)), "]", 1)).try_cast("timestamp").alias("logged_at"),
        *[log_field(line, k).alias(k) for k in TEXT_LOG_FIELDS],
        log_field(line, "duration_ms").try_cast("bigint").alias("duration_ms"),
        F.coalesce(line.contains(" event="), F.lit(False)).alias("parsed"),
        line.alias("line"),
    )


def read_text_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_log_lines(spark.read.text(path))


def read_json_log(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, with all its other fields in the map ``extra`` (values as JSON).

    A line that is no object is kept whole in ``_corrupt_record``.
    """
    line = F.col("value")
    read = computed_once(spark.read.text(path), [], {
        "line": line, "fields": F.from_json(line, ", ".join(f"{k} {t}" for k, t in JSON_LOG_FIELDS.items())),
        "value": F.try_parse_json(line),
    })
    is_object = F.coalesce(F.schema_of_variant("value").startswith("OBJECT"), F.lit(False))
    members = F.from_json(F.when(is_object, F.col("line")), "map<string,variant>")
    known = F.map_filter(members, lambda k, _: ~k.isin(*JSON_LOG_FIELDS))
    return read.select(
        *[F.when(is_object, F.col("fields").getField(k)).alias(k) for k in JSON_LOG_FIELDS],
        F.transform_values(known, lambda _, v: F.to_json(v)).alias("extra"),
        F.when(~is_object, F.col("line")).alias("_corrupt_record"),
    )
