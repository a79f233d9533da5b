"""Prompt per tenant, answer from a provider, and the parsed answer.

The provider is the only place where Python runs on rows. Everything around it is built-in.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.constants import (
    AVERAGE_MODEL_NAME,
    AVERAGE_MODEL_VERSION,
    DEFAULT_LOCATION_ID,
    DEFAULT_RESTAURANT_ID,
    HORIZON_DAYS,
    INSIGHT_KEYS,
    MONEY,
    PREVIEW_CHARS,
    RECENT_DAYS,
    TENANT,
)
from tillcast.functions import payload
from tillcast.functions.staging import computed_once
from tillcast.functions.text import first_filled, truncate

# Reasons reported by the insight step.
NO_KEY_REASON = "OPENAI_API_KEY_not_set"
CALL_FAILED = "openai_call_failed"

ANSWER_SCHEMA = (
    "restaurant_id string, location_id string, prompt string, "
    "status string, reason string, model string, raw_json string"
)

PROMPT_HEAD = "\n".join(
    [
        "You advise the manager of one restaurant location.",
        "Use the sales context below to give short operating advice.",
        "",
        "Answer format:",
        "- one JSON object, no other text",
        f"- keys: {', '.join(INSIGHT_KEYS)}",
        "- actions: a list of exactly 3 short texts",
        "- every other value: a short text",
        "",
        "Context:",
    ]
)


def recent_sales(sales: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """The last sales of each tenant. The rank filter also cuts rows before the shuffle."""
    latest = Window.partitionBy(*TENANT).orderBy(F.col("date").desc())
    return (
        sales.withColumn("rank", F.row_number().over(latest))
        .where(F.col("rank") <= days)
        .drop("rank")
    )


def recent_arrays(sales: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """The last sales of each tenant as one array in date order."""
    entry = F.struct("date", F.col("daily_sales_total").cast(MONEY).alias("daily_sales_total"))
    return (
        recent_sales(sales, days)
        .groupBy(*TENANT)
        .agg(F.sort_array(F.collect_list(entry)).alias("recent_sales"))
    )


def resolve_ids(prediction: Column, ingestion: Column) -> list[Column]:
    """Tenant of a context: from its prediction, else its ingestion, else the default."""
    defaults = {"restaurant_id": DEFAULT_RESTAURANT_ID, "location_id": DEFAULT_LOCATION_ID}
    return [
        F.coalesce(
            first_filled(payload.field(prediction, f"$.{name}"), payload.field(ingestion, f"$.{name}")),
            F.lit(default),
        ).alias(name)
        for name, default in defaults.items()
    ]


def read_contexts(contexts: DataFrame, context: str, *keep: str) -> DataFrame:
    """Prompt inputs of stored run contexts held as a variant.

    Every part of a context is looked up once and kept as a column before its fields are read.
    """
    def stage(df: DataFrame, columns: dict[str, Column], *more: str) -> DataFrame:
        return computed_once(df, [*keep, *more], columns)

    whole = F.col(context)
    parts = stage(contexts, {
        "_whole": whole,
        "_named": payload.field(whole, "$['5_ml_prediction']", "variant"),
        "_inner": payload.field(whole, "$.data", "variant"),
        "_ingested": payload.field(whole, "$['1_data_ingestion']", "variant"),
    })
    objects = stage(parts, {
        "_prediction": payload.chosen_prediction(F.col("_named"), F.col("_inner"), F.col("_whole")),
        "_ingestion": payload.object_or_null(F.col("_ingested")),
    })
    prediction, ingestion = F.col("_prediction"), F.col("_ingestion")
    amounts = "array<struct<predicted_sales decimal(18,2)>>"
    entries = "array<struct<date string, daily_sales_total decimal(18,2)>>"
    fields = stage(objects, {
        **{c: ids for c, ids in zip(TENANT, resolve_ids(prediction, ingestion))},
        "_horizon": payload.field(prediction, "$.horizon", "int"),
        "model_used": F.coalesce(payload.field(prediction, "$.model_used", "string"), F.lit("{}")),
        "_forecast": payload.field(prediction, "$.forecast", amounts),
        "_intervals": payload.field(prediction, "$.forecast_intervals", amounts),
        "_sales": payload.field(ingestion, "$.sales", entries),
    })
    listed = F.when(F.size("_forecast") > 0, F.col("_forecast")).when(F.size("_intervals") > 0, F.col("_intervals"))
    forecast = F.coalesce(F.transform(listed, lambda d: d["predicted_sales"]), F.array().cast(f"array<{MONEY}>"))
    last = F.slice("_sales", F.greatest(F.lit(1), F.size("_sales") - (RECENT_DAYS - 1)), RECENT_DAYS)
    return fields.select(
        *keep,
        *TENANT,
        F.coalesce("_horizon", F.size(forecast)).alias("horizon"),
        "model_used",
        F.coalesce(last, F.array().cast(entries)).alias("recent_sales"),
        forecast.alias("forecast"),
    )


def prompt_text(row: dict[str, Column]) -> Column:
    line = {name: F.concat(F.lit(f"- {name}: "), value) for name, value in row.items()}
    return F.concat_ws("\n", F.lit(PROMPT_HEAD), *line.values())


def prompts_from_context(contexts: DataFrame) -> DataFrame:
    """Prompts from columns as produced by :func:`read_contexts`."""
    text = prompt_text(
        {
            "restaurant_id": F.col("restaurant_id"),
            "location_id": F.col("location_id"),
            "horizon": F.col("horizon").cast("string"),
            "model_used": F.col("model_used"),
            "recent_sales": F.to_json("recent_sales"),
            "forecast": F.to_json(
                F.transform("forecast", lambda amount: F.struct(amount.alias("predicted_sales")))
            ),
        }
    )
    return contexts.withColumn("prompt", text)


def build_prompts(forecasts: DataFrame, horizon: int = HORIZON_DAYS) -> DataFrame:
    """Adds the prompt to tenants with ``forecast`` and ``recent_sales``; row-local."""
    model = json.dumps(
        {"model_name": AVERAGE_MODEL_NAME, "model_version": AVERAGE_MODEL_VERSION}, separators=(",", ":")
    )
    empty = F.array().cast(forecasts.schema["recent_sales"].dataType)
    return prompts_from_context(
        forecasts.withColumns(
            {
                "horizon": F.lit(horizon),
                "model_used": F.lit(model),
                "recent_sales": F.coalesce("recent_sales", empty),
            }
        )
    )


def prompt_preview(prompt: Column) -> Column:
    return truncate(prompt, PREVIEW_CHARS)


def call_provider(prompts: DataFrame, call: Callable[[str], dict], parallel: int) -> DataFrame:
    """Ask an external service, one call per prompt.

    ``call`` returns ``status`` with ``model`` and ``raw_json``, or with ``reason``. A call that
    raises marks its own row as an error. The prompts are spread by tenant over ``parallel`` tasks,
    which is also the number of concurrent calls. A repeated task repeats its calls: store the
    answers before anything else reads them, as ``daily_run`` does.
    """

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> dict:
            try:
                return call(prompt)
            except Exception as e:
                return {"status": "error", "reason": f"{CALL_FAILED}:{type(e).__name__}:{e}"}

        for batch in batches:
            answers = pd.DataFrame([one(p) for p in batch["prompt"]], index=batch.index)
            answers = answers.reindex(columns=["status", "reason", "model", "raw_json"])
            yield pd.concat([batch, answers.astype(object).where(answers.notna(), None)], axis=1)

    asked = prompts.select(*TENANT, "prompt").repartition(parallel, *TENANT)
    return asked.mapInPandas(ask, ANSWER_SCHEMA)


def ask(
    prompts: DataFrame,
    provider: Callable[[DataFrame], DataFrame] | None = None,
    reason: str = NO_KEY_REASON,
) -> DataFrame:
    """Answers of the provider; without one every tenant is skipped, with no Python involved."""
    if provider is not None:
        return provider(prompts)
    absent = F.lit(None).cast("string")
    return prompts.withColumns(
        {"status": F.lit("skipped"), "reason": F.lit(reason), "model": absent, "raw_json": absent}
    )


def parse_answers(answers: DataFrame, *keep: str) -> DataFrame:
    """Status, parsed answer and warnings per tenant, with further columns carried along.

    An answer that is not a JSON object stays ``ok`` with a warning and without content.
    """
    answered = F.col("status") == "ok"
    raw = F.when(answered, F.coalesce("raw_json", F.lit("{}")))
    staged = (
        answers.withColumn("insight_json_raw", raw)
        .withColumn("parsed", payload.parsed(F.col("insight_json_raw")))
        .withColumn("verdict", payload.verdict(F.col("parsed")))
        .withColumn("insight_json", payload.object_or_null(F.col("parsed")))
    )
    value = F.col("insight_json")
    warning = F.struct(F.lit("JsonParseWarning").alias("type"), F.col("verdict").alias("message"))
    no_warning = F.array().cast("array<struct<type string, message string>>")
    return staged.select(
        *TENANT,
        F.when(F.col("status").isin("ok", "skipped"), F.col("status"))
        .otherwise(F.lit("error"))
        .alias("insight_status"),
        "model",
        F.when(~answered, F.col("reason")).alias("reason"),
        F.when(~answered, prompt_preview(F.col("prompt"))).alias("prompt_preview"),
        "insight_json_raw",
        "insight_json",
        F.when(answered & (F.col("verdict") != "ok"), F.array(warning)).otherwise(no_warning).alias("warnings"),
        risk_level(value).alias("risk_level"),
        actions(value).alias("actions"),
        *keep,
    )


def risk_level(insight: Column) -> Column:
    return payload.field(insight, "$.risk_level")


def actions(insight: Column) -> Column:
    """The listed actions as texts; empty where there is no list."""
    listed = payload.field(insight, "$.actions", "variant")
    return F.coalesce(
        F.when(payload.is_array(listed), payload.field(insight, "$.actions", "array<string>")),
        F.array().cast("array<string>"),
    )
