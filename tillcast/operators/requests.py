"""Audit of run requests: which steps a request resolves to and what it names wrongly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.constants import STEP_NAMES
from tillcast.functions.text import comma_list, filled, parse_bool, strip


def slice_plan(plan: Column, start_at: Column, stop_after: Column) -> Column:
    """The part of the plan between two steps; a step that is not in the plan cuts nothing."""
    first = F.coalesce(F.array_position(plan, start_at), F.lit(0))
    begun = F.when(first > 0, F.slice(plan, first.cast("int"), F.size(plan))).otherwise(plan)
    last = F.coalesce(F.array_position(begun, stop_after), F.lit(0))
    return F.when(last > 0, F.slice(begun, F.lit(1), last.cast("int"))).otherwise(begun)


def audit_requests(requests: DataFrame, known_steps: list[str] | None = None) -> DataFrame:
    """Resolve every request on its own row: no shuffle, whatever the number of requests.

    Expects ``request_id, steps, exclude_steps, start_at, stop_after, strict`` as texts. A strict
    request with unknown names is refused and keeps the plan it selected.
    """
    names = STEP_NAMES if known_steps is None else known_steps
    known = F.array(*[F.lit(n) for n in names])
    none = F.array().cast("array<string>")
    asked = comma_list(F.col("steps"))
    excluded = F.coalesce(comma_list(F.col("exclude_steps")), none)
    start, stop = filled(strip(F.col("start_at"))), filled(strip(F.col("stop_after")))

    def unknown_one(name: Column) -> Column:
        is_unknown = name.isNotNull() & ~F.array_contains(known, F.coalesce(name, F.lit("")))
        return F.when(is_unknown, F.array(name)).otherwise(none)

    named = requests.select(
        "request_id",
        F.coalesce(F.array_intersect(asked, known), known).alias("selected"),
        F.coalesce(F.array_except(asked, known), none).alias("unknown_steps"),
        F.array_distinct(
            F.concat(unknown_one(start), unknown_one(stop), F.array_except(excluded, known))
        ).alias("unknown_selectors"),
        excluded.alias("excluded"),
        start.alias("start_at"),
        stop.alias("stop_after"),
        parse_bool(F.col("strict"), default=True).alias("strict"),
    )
    bad_step, bad_selector = F.size("unknown_steps") > 0, F.size("unknown_selectors") > 0
    refused = F.col("strict") & (bad_step | bad_selector)
    sliced = slice_plan(
        F.array_except("selected", "excluded"), F.col("start_at"), F.col("stop_after")
    )
    plan = F.when(refused, F.col("selected")).otherwise(sliced)
    return named.select(
        "request_id",
        plan.alias("plan"),
        "unknown_steps",
        "unknown_selectors",
        F.when(F.col("strict") & bad_step, F.lit("unknown_steps"))
        .when(refused, F.lit("unknown_selectors"))
        .when(bad_step | bad_selector, F.lit("unknown_values_ignored"))
        .otherwise(F.lit("ok"))
        .alias("verdict"),
        F.size(plan).alias("steps_planned"),
    )


def unknown_step_counts(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """Table form of the membership test: how often each name outside the step table is asked for.

    Names are counted before the anti join, so a name that fills the request log is one row there.
    """
    asked = requests.select(F.explode_outer(comma_list(F.col("steps"))).alias("step"))
    return (
        asked.where(F.col("step").isNotNull())
        .groupBy("step")
        .agg(F.count(F.lit(1)).alias("requests"))
        .join(steps.select("step"), "step", "left_anti")
    )


def known_step_counts(requests: DataFrame, steps: DataFrame) -> DataFrame:
    """The same for names that are in the step table."""
    asked = requests.select(F.explode_outer(comma_list(F.col("steps"))).alias("step"))
    return (
        asked.where(F.col("step").isNotNull())
        .groupBy("step")
        .agg(F.count(F.lit(1)).alias("requests"))
        .join(steps.select("step"), "step", "left_semi")
    )
