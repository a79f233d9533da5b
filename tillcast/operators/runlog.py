"""Run log: summaries, latest runs, stored sales and step durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.constants import (
    DEFAULT_LOCATION_ID,
    DEFAULT_RESTAURANT_ID,
    INGESTION_STEP,
    MONEY,
    TENANT,
)
from tillcast.functions import payload
from tillcast.functions.staging import computed_once
from tillcast.functions.text import filled

RUN_DEFAULT_STATUS = "unknown"


def with_run_defaults(runs: DataFrame) -> DataFrame:
    """Stored form of run columns: status ``unknown`` and duration 0 where they are missing."""
    status = F.coalesce(filled(F.col("status")), F.lit(RUN_DEFAULT_STATUS))
    out = runs.withColumn("status", status)
    if "duration_ms" in runs.columns:
        out = out.withColumn("duration_ms", F.coalesce("duration_ms", F.lit(0).cast("bigint")))
    return out


def run_summary(steps: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """Step outcomes per run; combinable counts, so a run with many steps is no hot spot.

    With ``plans`` (``run_id, steps_planned``) the summary covers every planned run, also one of
    which no step returned.
    """
    status = F.col("status")
    errors = F.count_if(status == "error")
    outcome = with_run_defaults(steps).groupBy("run_id").agg(
        F.count_if(status == "ok").alias("ok_count"),
        errors.alias("error_count"),
        F.count_if(status == "skipped").alias("skipped_count"),
        (errors > 0).alias("has_errors"),
        F.count(F.lit(1)).alias("steps_returned"),
    )
    if plans is None:
        return outcome
    counts = ["ok_count", "error_count", "skipped_count", "steps_returned"]
    return plans.select("run_id", "steps_planned").join(outcome, "run_id", "left").select(
        "run_id",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts],
        F.coalesce("has_errors", F.lit(False)).alias("has_errors"),
        "steps_planned",
    )


def latest_run(runs: DataFrame, order: str = "seq") -> DataFrame:
    """The run stored last (top-1, no full sort)."""
    return runs.orderBy(F.col(order).desc()).limit(1)


def runs_of_tenant(
    runs: DataFrame, restaurant_id: str | None = None, location_id: str | None = None
) -> DataFrame:
    """Runs of one tenant; all runs unless both ids are given."""
    if not (restaurant_id and location_id):
        return runs
    return runs.where(
        (F.col("restaurant_id") == restaurant_id) & (F.col("location_id") == location_id)
    )


def latest_run_per_tenant(runs: DataFrame, order: str = "seq") -> DataFrame:
    """The run each tenant stored last.

    ``order`` tells the runs of a tenant apart. Its greatest value per tenant stays in a hash table,
    and the row is met again by an equality join; whole rows are never sorted.
    """
    latest = runs.groupBy(*TENANT).agg(F.max(order).alias(order))
    return runs.join(latest, [*TENANT, order]).select(*runs.columns)


def decode_payload(runs: DataFrame) -> DataFrame:
    """Adds the payload as a variant; NULL where the text is not JSON."""
    return runs.withColumn("payload", payload.parsed(F.col("payload_json")))


def _results(run: Column) -> Column:
    return payload.field(run, "$.results", "array<variant>")


def _first(matches: Column) -> Column:
    return F.get(matches, F.lit(0))


def run_tenants(decoded: DataFrame) -> DataFrame:
    """Tenant of each stored run.

    The ids of the run itself, unless both are the defaults; then those of the first step that
    carries either id.
    """
    run = F.col("payload")
    carried = [c for c in decoded.columns if c not in TENANT]

    def ids(step: Column) -> Column:
        return F.struct(
            filled(payload.field(step, "$.data.restaurant_id")).alias("restaurant_id"),
            filled(payload.field(step, "$.data.location_id")).alias("location_id"),
        )

    own = decoded.select(
        *carried,
        F.coalesce(filled(payload.field(run, "$.restaurant_id")), F.lit(DEFAULT_RESTAURANT_ID)).alias("own_restaurant"),
        F.coalesce(filled(payload.field(run, "$.location_id")), F.lit(DEFAULT_LOCATION_ID)).alias("own_location"),
    )
    named = (F.col("own_restaurant") != DEFAULT_RESTAURANT_ID) | (F.col("own_location") != DEFAULT_LOCATION_ID)
    steps = _results(payload.object_or_null(payload.field(run, "$.result", "variant")))
    either = F.filter(
        F.transform(steps, ids), lambda s: s["restaurant_id"].isNotNull() | s["location_id"].isNotNull()
    )
    return (
        own.withColumn("named", named)
        .withColumn("step_ids", F.when(~F.col("named"), _first(either)))
        .select(
            *carried,
            F.when(F.col("named"), F.col("own_restaurant"))
            .otherwise(F.coalesce("step_ids.restaurant_id", F.lit(DEFAULT_RESTAURANT_ID)))
            .alias("restaurant_id"),
            F.when(F.col("named"), F.col("own_location"))
            .otherwise(F.coalesce("step_ids.location_id", F.lit(DEFAULT_LOCATION_ID)))
            .alias("location_id"),
        )
    )


def _step_tenant(step: Column) -> list[Column]:
    """Tenant named by an ingestion step, else the defaults."""
    return [
        F.coalesce(filled(payload.field(step, "$.data.restaurant_id")), F.lit(DEFAULT_RESTAURANT_ID))
        .alias("restaurant_id"),
        F.coalesce(filled(payload.field(step, "$.data.location_id")), F.lit(DEFAULT_LOCATION_ID))
        .alias("location_id"),
    ]


def _is_ingestion(step: Column) -> Column:
    named = payload.field(step, "$.step") == INGESTION_STEP
    return F.coalesce(named, F.lit(False)) & payload.is_object(payload.field(step, "$.data", "variant"))


def _sales_list(step: Column) -> Column:
    listed = payload.field(step, "$.data.sales", "variant")
    return F.when(payload.is_array(listed), payload.field(step, "$.data.sales", "array<variant>"))


def stored_sales(decoded: DataFrame, strict: bool) -> DataFrame:
    """Adds the ingestion step of a stored run and its sales entries, an array of variants.

    Strict takes the first ingestion step whose entries are all objects; otherwise the first
    ingestion step counts and entries that are no objects are dropped. Each stage is a column of its
    own, so that no part of a payload is searched twice.
    """
    staged = decoded.withColumn("run", payload.unwrap_result(F.col("payload"))).withColumn(
        "steps", F.filter(_results(F.col("run")), _is_ingestion)
    )
    if not strict:
        first = staged.withColumn("step", _first(F.col("steps"))).withColumn("listed", _sales_list(F.col("step")))
        return first.withColumn("sales", F.filter("listed", payload.is_object))
    with_lists = staged.withColumn(
        "candidates", F.transform("steps", lambda s: F.struct(s.alias("step"), _sales_list(s).alias("sales")))
    )
    whole = F.filter(
        "candidates", lambda c: F.coalesce(F.forall(c["sales"], payload.is_object), F.lit(False))
    )
    return (
        with_lists.withColumn("found", _first(whole))
        .withColumn("step", _first(F.col("steps")))
        .withColumn("sales", F.col("found.sales"))
    )


def _amount(entry: Column) -> Column:
    """The amount of an entry if it is stored as a number; text does not count."""
    kind = F.schema_of_variant(payload.field(entry, "$.daily_sales_total", "variant"))
    number = ~kind.rlike("^(STRING|ARRAY|OBJECT|VOID)")
    return F.when(number, payload.field(entry, "$.daily_sales_total", MONEY))


def extract_sales(runs: DataFrame, strict: bool = True) -> DataFrame:
    """Sales rows stored inside run payloads, with the tenant of the ingestion step."""
    entry = F.col("entry")
    return (
        stored_sales(decode_payload(runs), strict)
        .select("run_id", *_step_tenant(F.col("step")), F.explode_outer("sales").alias("entry"))
        .where(entry.isNotNull())
        .select(
            "run_id",
            *TENANT,
            payload.field(entry, "$.date").alias("date"),
            _amount(entry).alias("daily_sales_total"),
        )
    )


def sales_of_latest_run(runs: DataFrame, strict: bool = True, order: str = "seq") -> DataFrame:
    return extract_sales(latest_run(runs, order), strict)


def latest_stored_sales(runs: DataFrame, strict: bool = True, order: str = "seq") -> DataFrame:
    """Sales rows of each tenant's newest run that holds usable ones; runs without are passed over.

    A usable entry has an amount stored as a number. Rows keep their place in the list (``ingest_seq``). Payloads are
    read once: a run's sales stay one array until the newest run is known, and the ranking is cut to one
    run per tenant before the shuffle.
    """
    found = stored_sales(decode_payload(runs), strict)
    entries = F.transform("sales", lambda e: F.struct(payload.field(e, "$.date").alias("date"), _amount(e).alias("daily_sales_total")))
    read = computed_once(found, ["run_id", order], {"tenant": F.struct(*_step_tenant(F.col("step"))), "entries": entries})
    usable = read.where(F.exists("entries", lambda e: e["daily_sales_total"].isNotNull()))
    newest = F.row_number().over(Window.partitionBy("tenant").orderBy(F.col(order).desc()))
    chosen = usable.withColumn("newest", newest).where("newest = 1")
    return chosen.select("run_id", "tenant.*", F.posexplode("entries").alias("ingest_seq", "entry")).select(
        "run_id", *TENANT, "ingest_seq", "entry.date", "entry.daily_sales_total"
    )


def step_durations(lines: DataFrame, share: float = 0.95) -> DataFrame:
    """Durations per step from parsed log lines.

    Lines are first counted by step and duration, so that the percentile, which is exact and interpolated, is taken
    from the running count over distinct durations; no step gathers its values.
    """
    took = lines.where((F.col("event") == "step_done") & F.col("duration_ms").isNotNull())
    counts = took.groupBy("step", "duration_ms").agg(F.count(F.lit(1)).alias("n"))
    step = Window.partitionBy("step")
    ranked = counts.select(
        "step", "duration_ms", "n",
        F.sum("n").over(step.orderBy("duration_ms").rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("through"),
        F.sum("n").over(step.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("runs"),
    )
    place = (F.col("runs") - 1) * F.lit(share)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("through") > rank) & (F.col("through") - F.col("n") <= rank), F.col("duration_ms")))

    total = F.sum(F.col("duration_ms").cast("decimal(38,0)") * F.col("n"))
    return (
        ranked.groupBy("step")
        .agg(
            F.first("runs").alias("runs"),
            (total.cast("double") / F.first("runs")).alias("avg_ms"),
            F.max("duration_ms").alias("max_ms"),
            at(F.floor(place)).alias("low"),
            at(F.ceil(place)).alias("high"),
        )
        .select("step", "runs", "avg_ms", "max_ms", (F.col("low") + (F.col("high") - F.col("low")) * (place - F.floor(place))).alias("p95_ms"))
    )
