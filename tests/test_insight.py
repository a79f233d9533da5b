from __future__ import annotations

import json

import pytest

from pyspark.sql import functions as F

from conftest import SAMPLE
from tillcast.constants import INSIGHT_KEYS
from tillcast.functions import payload
import local_provider
from tillcast.operators import dashboard, insight
from tillcast.operators.forecast import daily_plan, forecast, with_forecast
from tillcast.operators.models import tenant_profiles

T = ("r", "l")
ANSWERS = "restaurant_id string, location_id string, prompt string, status string, reason string, model string, raw_json string"


def prompts(sales):
    return insight.build_prompts(with_forecast(tenant_profiles(sales)))


def test_recent_sales_keeps_order_and_short_series(make_sales):
    sales = make_sales({("r", "long"): SAMPLE, ("r", "short"): SAMPLE[:3]})
    got = {r.location_id: [int(s.daily_sales_total) for s in r.recent_sales] for r in insight.recent_arrays(sales).collect()}
    assert got == {"long": SAMPLE[-7:], "short": SAMPLE[:3]}


def test_prompt_holds_its_context(make_sales):
    text = prompts(make_sales({T: SAMPLE})).first().prompt
    lines = dict(l[2:].split(": ", 1) for l in text.splitlines() if l.startswith("- ") and ": " in l)
    assert lines["restaurant_id"] == "r" and lines["horizon"] == "7"
    assert [d["daily_sales_total"] for d in json.loads(lines["recent_sales"])] == SAMPLE[-7:]
    assert [d["predicted_sales"] for d in json.loads(lines["forecast"])][:2] == [1549.38, 1580.37]
    assert json.loads(lines["model_used"])["model_name"] == "average_daily_sales_model"


def test_without_provider_all_are_skipped(make_sales):
    got = insight.parse_answers(insight.ask(prompts(make_sales({T: SAMPLE})))).first()
    assert (got.insight_status, got.reason) == ("skipped", "OPENAI_API_KEY_not_set")
    assert len(got.prompt_preview) == 600 and got.prompt_preview.endswith("...")
    assert (got.insight_json, got.risk_level, got.actions) == (None, None, [])


def test_local_providers_agree(make_sales):
    sales = make_sales({
        ("r", "high"): [1000] * 10 + [100] * 7,
        ("r", "low"): [100] * 10 + [1000] * 7,
        ("r", "medium"): [110] * 7 + [100] * 7,
        ("r", "one"): [5],
    })
    asked = prompts(sales)
    rules = insight.parse_answers(insight.ask(asked, local_provider.rule_provider))
    calls = insight.parse_answers(insight.call_provider(asked, local_provider.prompt_rule(), parallel=3))
    columns = ["location_id", "insight_status", "model", "insight_json_raw", "risk_level", "actions"]
    left = sorted(rules.select(columns).collect())
    assert left == sorted(calls.select(columns).collect())
    assert {r.location_id: r.risk_level for r in left} == {"high": "high", "low": "low", "medium": "medium", "one": "low"}
    answer = json.loads(left[0].insight_json_raw)
    assert list(answer) == INSIGHT_KEYS and len(answer["actions"]) == 3


def test_failing_call_marks_its_own_row(make_sales):
    def call(prompt):
        if "location_id: bad" in prompt:
            raise TimeoutError("slow")
        return {"status": "ok", "model": "m", "raw_json": "{}"}

    asked = prompts(make_sales({("r", "bad"): SAMPLE, ("r", "good"): SAMPLE}))
    got = {r.location_id: r for r in insight.parse_answers(insight.call_provider(asked, call, parallel=2)).collect()}
    assert (got["bad"].insight_status, got["bad"].reason) == ("error", "openai_call_failed:TimeoutError:slow")
    assert got["bad"].prompt_preview is not None
    assert (got["good"].insight_status, got["good"].reason, got["good"].prompt_preview) == ("ok", None, None)


def test_parse_answers_edges(spark):
    raws = {
        "object": '{"risk_level":"low","actions":["a",2,"c"]}',
        "array": "[1]", "broken": '{"a":', "no_list": '{"risk_level":null,"actions":"a"}', "missing": None,
    }
    rows = [("r", k, "p", "ok", None, "m", v) for k, v in raws.items()]
    got = {r.location_id: r for r in insight.parse_answers(spark.createDataFrame(rows, ANSWERS)).collect()}
    assert (got["object"].risk_level, got["object"].actions, got["object"].warnings) == ("low", ["a", "2", "c"], [])
    for name, message in (("array", "json_not_object"), ("broken", "json_parse_failed")):
        assert got[name].insight_status == "ok" and got[name].actions == []
        assert [tuple(w) for w in got[name].warnings] == [("JsonParseWarning", message)]
    assert (got["no_list"].risk_level, got["no_list"].actions) == (None, [])
    assert (got["missing"].insight_json_raw, got["missing"].warnings) == ("{}", [])


def test_context_columns(spark):
    contexts = [
        '{"5_ml_prediction":{"restaurant_id":"p","location_id":"","forecast":[{"predicted_sales":1.5}]},'
        '"1_data_ingestion":{"restaurant_id":"i","location_id":"il","sales":['
        + ",".join(f'{{"date":"2025-01-{d:02d}","daily_sales_total":{d}}}' for d in range(1, 10)) + "]}}",
        '{"forecast":[],"forecast_intervals":[{"predicted_sales":2}],"horizon":9}',
        "{}",
    ]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contexts)], "i int, c string")
    parsed = df.orderBy("i").withColumn("v", payload.parsed(F.col("c")))
    rows = insight.read_contexts(parsed, "v", "i").orderBy("i").collect()
    assert (rows[0].restaurant_id, rows[0].location_id, rows[0].horizon) == ("p", "il", 1)
    assert [int(s.daily_sales_total) for s in rows[0].recent_sales] == list(range(3, 10))
    assert (rows[1].restaurant_id, rows[1].location_id, rows[1].horizon) == ("restaurant_001", "location_001", 9)
    assert [float(x) for x in rows[1].forecast] == [2.0] and rows[1].recent_sales == []
    assert (rows[2].horizon, rows[2].forecast, rows[2].model_used) == (0, [], "{}")
    assert insight.prompts_from_context(insight.read_contexts(parsed, "v")).count() == 3


def test_dashboard_forms_agree(make_sales):
    sales = make_sales({("r", str(i)): SAMPLE[i:] for i in range(4)})
    profiles = tenant_profiles(sales)
    single = dashboard.dashboard_from_profiles(profiles, local_provider.rule_provider)
    answers = insight.parse_answers(insight.ask(prompts(sales), local_provider.rule_provider))
    joined = dashboard.dashboard_days(forecast(profiles), answers)
    assert sorted(single.collect()) == sorted(joined.select(*single.columns).collect())
    assert single.count() == 28
    record = dashboard.dashboard_records(with_forecast(profiles), answers).first()
    assert len(record.forecast) == len(record.staffing_plan) == len(record.inventory_plan) == 7
    assert [d.day_index for d in record.staffing_plan] == list(range(1, 8)) and len(record.actions) == 3


def test_dashboard_without_insight(make_sales):
    profiles = tenant_profiles(make_sales({T: SAMPLE}))
    none = insight.parse_answers(insight.ask(insight.build_prompts(with_forecast(profiles)))).limit(0)
    got = dashboard.dashboard_days(forecast(profiles), none).first()
    assert (got.insight_status, got.risk_level, got.n_actions) == (None, None, 0)


@pytest.mark.parametrize("provider", [None, local_provider.rule_provider])
def test_parts_of_a_run_or_recomputed(spark, make_sales, provider):
    names = [f"t{i}" for i in range(8)]
    profiles = tenant_profiles(make_sales({("r", n): SAMPLE for n in names}))
    at = F.substring("location_id", 2, 1).cast("int")
    fresh = daily_plan(forecast(profiles))
    plan = {r.day_index: r for r in fresh.where("location_id = 't0'").collect()}
    forecasts = profiles.where(at % 2 == 1).select("restaurant_id", "location_id", F.array(*[F.lit(d).cast("decimal(18,2)") for d in (600, 1300)]).alias("forecast"))
    staffing = profiles.where(at % 4 >= 2).select("restaurant_id", "location_id", F.expr("array(named_struct('day_index', 2, 'recommended_staff', 9))").alias("staffing_plan"))
    insights = profiles.where(at >= 4).select("restaurant_id", "location_id", F.lit("ok").alias("insight_status"), F.lit("x").alias("risk_level"), F.array(F.lit("a")).alias("actions"))
    asked = []

    def counting(prompts):
        asked.append({r.location_id for r in prompts.select("location_id").collect()})
        return provider(prompts)

    board = dashboard.dashboard_from_run(profiles, forecasts, staffing, insights, counting if provider else None)
    got = {(r.location_id, r.day_index): r for r in board.collect()}
    assert not provider or asked == [{"t0", "t1", "t2", "t3"}]
    for i, n in enumerate(names):
        days = {1: ("600.00", 1), 2: ("1300.00", 2)} if i % 2 else {d: (str(r.predicted_sales), r.recommended_staff) for d, r in plan.items()}
        for d, (amount, staff) in days.items():
            r = got.pop((n, d))
            assert (str(r.predicted_sales), r.recommended_staff) == (amount, 9 if i % 4 >= 2 and d == 2 else staff)
            assert (r.insight_status, r.n_actions) == (("ok", 1) if i >= 4 else ("ok", 3) if provider else ("skipped", 0))
    assert not got
