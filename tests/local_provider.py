"""Fixed-rule stand-ins for a language model, for tests of the provider hook only."""

from __future__ import annotations

import json
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_MODEL = "local_rules"
RISK_LEVELS = ["unknown", "high", "medium", "low"]


def _risk(next_day: Column, recent_sum: Column, recent_count: Column) -> Column:
    """Risk of over-preparing: how far the forecast lies above the recent average."""
    scaled = next_day * recent_count
    return (
        F.when((recent_count == 0) | next_day.isNull(), F.lit("unknown"))
        .when(scaled >= recent_sum * F.lit(Decimal("1.25")), F.lit("high"))
        .when(scaled >= recent_sum * F.lit(Decimal("1.05")), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def _advice(risk: str) -> dict:
    """The fixed wording of a local answer."""
    return {
        "summary": f"forecast risk is {risk}",
        "staffing": "follow the staffing plan",
        "inventory": "follow the inventory plan",
        "waste": "check leftovers at close",
        "notes": "rule based advice",
        "risk_level": risk,
        "actions": ["confirm the roster", "confirm the orders", "review the waste log"],
    }


def rule_provider(prompts: DataFrame) -> DataFrame:
    """Local stand-in for a language model, as plain columns."""
    zero = F.lit(Decimal(0)).cast("decimal(28,2)")
    total = F.aggregate(
        "recent_sales", zero, lambda acc, s: (acc + s["daily_sales_total"]).cast("decimal(28,2)")
    )
    risk = _risk(
        F.get(F.col("forecast"), F.lit(0)), total, F.size("recent_sales").cast("decimal(10,0)")
    )
    answers = F.create_map(
        *[
            part
            for level in RISK_LEVELS
            for part in (F.lit(level), F.lit(json.dumps(_advice(level), separators=(",", ":"))))
        ]
    )
    return prompts.withColumns(
        {
            "status": F.lit("ok"),
            "reason": F.lit(None).cast("string"),
            "model": F.lit(LOCAL_MODEL),
            "raw_json": F.element_at(answers, risk),
        }
    )


def prompt_rule() -> Callable[[str], dict]:
    """The same rule for one prompt text, as a stand-in for a network call.

    The returned function carries all it needs, so workers do not import this package for it.
    """
    answers = {level: json.dumps(_advice(level), separators=(",", ":")) for level in RISK_LEVELS}

    def answer(prompt: str) -> dict:
        context = dict(
            line[2:].split(": ", 1)
            for line in prompt.splitlines()
            if line.startswith("- ") and ": " in line
        )
        recent = json.loads(context["recent_sales"], parse_float=Decimal, parse_int=Decimal)
        coming = json.loads(context["forecast"], parse_float=Decimal, parse_int=Decimal)
        if not recent or not coming:
            risk = "unknown"
        else:
            scaled = coming[0]["predicted_sales"] * len(recent)
            total = sum(day["daily_sales_total"] for day in recent)
            if scaled >= total * Decimal("1.25"):
                risk = "high"
            elif scaled >= total * Decimal("1.05"):
                risk = "medium"
            else:
                risk = "low"
        return {"status": "ok", "model": LOCAL_MODEL, "raw_json": answers[risk]}

    return answer
