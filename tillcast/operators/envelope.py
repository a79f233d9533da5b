"""Step envelopes: defaults, status, and normalised step output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.functions import payload

# Envelope keys that are not step data.
ENVELOPE_KEYS = ["errors", "warnings", "metrics", "status", "step"]
UPSTREAM_ERROR = "UpstreamError"


def step_status(errors: Column) -> Column:
    return F.when(F.size(errors) == 0, F.lit("ok")).otherwise(F.lit("error"))


def or_empty(values: Column, element: str = "string") -> Column:
    return F.coalesce(values, F.array().cast(f"array<{element}>"))


def with_envelope_defaults(steps: DataFrame) -> DataFrame:
    """Empty lists and maps in place of missing ones."""
    out = steps
    for name in ("errors", "warnings"):
        if name in steps.columns:
            out = out.withColumn(name, or_empty(F.col(name)))
    if "metrics" in steps.columns:
        out = out.withColumn("metrics", F.coalesce("metrics", F.create_map().cast("map<string,string>")))
    return out


def with_status(steps: DataFrame) -> DataFrame:
    return with_envelope_defaults(steps).withColumn("status", step_status(F.col("errors")))


def demote_errors(steps: DataFrame, demoted: Column) -> DataFrame:
    """Turn the errors of the chosen steps into warnings, so that the step itself counts as ok."""
    shaped = with_envelope_defaults(steps)
    as_warnings = F.transform("errors", lambda e: F.concat(F.lit(f"{UPSTREAM_ERROR}: "), e))
    return (
        shaped.withColumn("warnings", F.when(demoted, F.concat("warnings", as_warnings)).otherwise(F.col("warnings")))
        .withColumn("errors", F.when(demoted, or_empty(F.lit(None))).otherwise(F.col("errors")))
        .withColumn("status", step_status(F.col("errors")))
    )


def _listed(value: Column) -> Column:
    """A variant as a list of JSON texts: nothing gives none, a scalar gives one."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | (kind == "VOID"), F.array().cast("array<string>"))
        .when(payload.is_array(value), F.transform(value.try_cast("array<variant>"), lambda v: F.to_json(v)))
        .otherwise(F.array(F.to_json(value)))
    )


def coerce_output(outputs: DataFrame, raw: str = "raw_json") -> DataFrame:
    """Normalise raw step outputs held as JSON text.

    An object gives its ``data``, or everything outside the envelope keys; any other value, also
    text that is not JSON, is wrapped as ``{"value": ...}``. The text is parsed once; all parts come from its variant.
    """
    text, value, data = F.col(raw), F.col("_value"), F.col("_data")
    staged = (
        outputs.withColumn("_value", payload.parsed(text))
        .withColumn("_object", payload.object_or_null(value))
        .withColumn("_data", payload.field(F.col("_object"), "$.data", "variant"))
    )
    members = F.col("_object").cast("map<string,variant>")
    rest = F.map_filter(members, lambda k, _: ~k.isin([*ENVELOPE_KEYS, "data"]))
    wrapped = F.when(
        value.isNotNull(), F.concat(F.lit('{"value":'), F.to_json(value), F.lit("}"))
    ).otherwise(F.to_json(F.struct(text.alias("value"))))
    is_object = F.col("_object").isNotNull()
    has_data = data.isNotNull() & (F.schema_of_variant(data) != "VOID")

    def part(name: str) -> Column:
        return payload.field(F.col("_object"), f"$.{name}", "variant")

    metrics = F.to_json(payload.object_or_null(part("metrics")))
    return (
        staged.withColumns(
            {
                "data_json": F.when(has_data, F.to_json(data)).when(is_object, F.to_json(rest)).otherwise(wrapped),
                "errors": _listed(part("errors")),
                "warnings": _listed(part("warnings")),
                "metrics_json": F.coalesce(metrics, F.lit("{}")),
            }
        )
        .withColumn("status", step_status(F.col("errors")))
        .drop("_value", "_object", "_data")
    )
