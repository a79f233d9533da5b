"""JSON payloads of unknown shape, read through the variant type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(raw: Column) -> Column:
    """The JSON as a variant, or NULL where it cannot be parsed."""
    return F.try_parse_json(raw)


def is_object(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))


def is_array(value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith("ARRAY"), F.lit(False))


def object_or_null(value: Column) -> Column:
    return F.when(is_object(value), value)


def field(value: Column, path: str, as_type: str = "string") -> Column:
    """One field of a variant, or NULL where it is absent or of another type."""
    return F.try_variant_get(value, path, as_type)


def verdict(value: Column) -> Column:
    """``ok`` for a parsed object, else why the text was not one."""
    return (
        F.when(value.isNull(), F.lit("json_parse_failed"))
        .when(is_object(value), F.lit("ok"))
        .otherwise(F.lit("json_not_object"))
    )


def unwrap_result(value: Column) -> Column:
    """The inner ``result`` object of a stored run, or the run itself."""
    return F.coalesce(object_or_null(field(value, "$.result", "variant")), value)


def chosen_prediction(named: Column, inner: Column, context: Column) -> Column:
    """The prediction part of a run context, from the parts it may be in.

    What stands under the step name counts, then what stands under ``data``, then the context itself;
    the last two only where they hold a forecast or a model.
    """
    return F.coalesce(
        object_or_null(named),
        F.when(_has_prediction(inner), object_or_null(inner)),
        F.when(_has_prediction(context), context),
    )


def _has_prediction(value: Column) -> Column:
    return (
        field(value, "$.forecast", "variant").isNotNull()
        | field(value, "$.model_used", "variant").isNotNull()
    )
