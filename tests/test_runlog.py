from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from tillcast.operators import runlog
from tillcast.sources.logs import parse_log_lines, read_json_log, read_text_log


def runs(spark, payloads):
    rows = [(i, f"run_{i}", p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "seq bigint, run_id string, payload_json string")


def test_run_summary(spark):
    rows = [("a", "ok"), ("a", "error"), ("a", "skipped"), ("b", "ok"), ("b", ""), ("b", None)]
    got = {r.run_id: tuple(r)[1:] for r in runlog.run_summary(spark.createDataFrame(rows, "run_id string, status string")).collect()}
    assert got == {"a": (1, 1, 1, True, 3), "b": (1, 0, 0, False, 3)}


def test_run_defaults(spark):
    df = spark.createDataFrame([(None, None), ("", 5)], "status string, duration_ms bigint")
    assert [tuple(r) for r in runlog.with_run_defaults(df).collect()] == [("unknown", 0), ("unknown", 5)]


def test_latest_runs(spark):
    rows = [(i, f"r{i % 3}", f"l{i % 2}", f"run_{i}") for i in range(100)]
    df = spark.createDataFrame(rows, "seq bigint, restaurant_id string, location_id string, run_id string").repartition(5)
    assert runlog.latest_run(df).first().run_id == "run_99"
    got = {(r.restaurant_id, r.location_id): r.seq for r in runlog.latest_run_per_tenant(df).collect()}
    expected = {}
    for seq, r, l, _ in rows:
        expected[(r, l)] = seq
    assert got == expected
    assert runlog.runs_of_tenant(df, "r1", "l0").count() == sum(1 for r in rows if r[1:3] == ("r1", "l0"))
    assert runlog.runs_of_tenant(df, "r1").count() == 100


def test_undecodable_payload_is_null(spark):
    got = runlog.decode_payload(runs(spark, ['{"a":1}', '{"a":'])).orderBy("seq").select(F.col("payload").isNull()).collect()
    assert [r[0] for r in got] == [False, True]


def test_run_tenants(spark):
    cases = [
        ({"restaurant_id": "r", "location_id": "l"}, ("r", "l")),
        ({"restaurant_id": "r"}, ("r", "location_001")),
        ({"restaurant_id": "restaurant_001", "result": {"results": [{"data": {"location_id": "x"}}]}}, ("restaurant_001", "x")),
        ({"result": {"results": [1, {"data": [1]}, {"data": {"restaurant_id": ""}},
                                 {"data": {"restaurant_id": "s"}}, {"data": {"restaurant_id": "t"}}]}}, ("s", "location_001")),
        ({"result": [1]}, ("restaurant_001", "location_001")),
        ("broken", ("restaurant_001", "location_001")),
    ]
    df = runlog.decode_payload(runs(spark, [c[0] for c in cases]))
    got = runlog.run_tenants(df).orderBy("seq").select("restaurant_id", "location_id").collect()
    assert [tuple(r) for r in got] == [c[1] for c in cases]


def step(sales, name="1_data_ingestion", **ids):
    return {"step": name, "data": {"sales": sales, **ids}}


A, B = {"date": "2025-01-01", "daily_sales_total": 5}, {"date": "2025-01-02", "daily_sales_total": 6.25}


def extract(spark, payloads, strict):
    out: dict[str, list] = {}
    for r in runlog.extract_sales(runs(spark, payloads), strict).collect():
        out.setdefault(r.run_id, []).append((r.date, None if r.daily_sales_total is None else float(r.daily_sales_total)))
    return {k: sorted(v) for k, v in out.items()}


def test_extract_sales_strict_and_lenient(spark):
    a, b = ("2025-01-01", 5.0), ("2025-01-02", 6.25)
    payloads = [
        {"results": [step([A, B])]},
        {"result": {"results": [step([A])]}},
        {"results": [step([A, "text"]), step([B])]},
        {"results": [step("simulated_sales_data"), step([B])]},
        {"results": [step([B], name="other"), {"step": "1_data_ingestion", "data": []}, step([A])]},
        {"results": "none"},
        {"results": [step([])]},
        "broken",
    ]
    assert extract(spark, payloads, True) == {
        "run_0": [a, b], "run_1": [a], "run_2": [b], "run_3": [b], "run_4": [a],
    }
    assert extract(spark, payloads, False) == {"run_0": [a, b], "run_1": [a], "run_2": [a], "run_4": [a]}


def test_amount_must_be_a_number(spark):
    rows = [{"date": "2025-01-01", "daily_sales_total": v} for v in ("5", None, [1])] + [{"date": "2025-01-01"}]
    assert extract(spark, [{"results": [step(rows)]}], True) == {"run_0": [("2025-01-01", None)] * 4}


def test_sales_of_latest_run_name_their_tenant(spark):
    df = runs(spark, [{"results": [step([A])]}, {"results": [step([B], restaurant_id="r", location_id="l")]}])
    got = runlog.sales_of_latest_run(df).collect()
    assert [(r.restaurant_id, r.location_id, r.date) for r in got] == [("r", "l", "2025-01-02")]


LINES = [
    "[2025-01-01T10:00:00.5] event=step_start run_id=r1 step=a",
    "[2025-01-01T10:00:01] event=step_done run_id=r1 step=a duration_ms=1500 status=ok",
    "[2025-01-01T10:00:02] event=step_done run_id=r1 step=a duration_ms=500 status=error duration_ms=9",
    "[2025-01-01T10:00:02] event=step_skip run_id=r1 step=b reason=no handler found",
    "no log line",
    "[x] event=step_done step=b duration_ms=many",
]


def test_log_lines(spark, tmp_path):
    path = tmp_path / "run.log"
    path.write_text("\n".join(LINES))
    parsed = read_text_log(spark, str(path))
    rows = parsed.collect()
    assert [r.line for r in rows] == LINES and [r.parsed for r in rows] == [True] * 4 + [False, True]
    assert str(rows[0].logged_at) == "2025-01-01 10:00:00.500000" and rows[5].logged_at is None
    assert (rows[3].reason, rows[2].duration_ms, rows[5].duration_ms) == ("no handler found", 500, None)
    got = runlog.step_durations(parsed).collect()
    assert [tuple(r) for r in got] == [("a", 2, 1000.0, 1500, 1450.0)]


def test_step_duration_percentile_against_sorted_values(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 10_000, 999)
    lines = spark.createDataFrame([(f"[t] event=step_done step=s duration_ms={v}",) for v in values.tolist()], "value string")
    got = runlog.step_durations(parse_log_lines(lines)).first()
    assert got.p95_ms == np.percentile(values, 95)
    assert (got.runs, got.max_ms) == (999, max(values))


def test_json_log_keeps_corrupt_lines(spark, tmp_path):
    path = tmp_path / "log.json"
    path.write_text('{"ts":"t","level":"INFO","event":"e","duration_ms":3,"other":1}\nbroken {\n')
    rows = read_json_log(spark, str(path)).cache().collect()
    assert (rows[0].level, rows[0].event, rows[0].duration_ms, rows[0]._corrupt_record) == ("INFO", "e", 3, None)
    assert rows[0].extra == {"other": "1"}
    assert rows[1]._corrupt_record == "broken {"


def test_summary_covers_planned_runs(spark):
    steps = spark.createDataFrame([("a", "ok"), ("a", "error")], "run_id string, status string")
    plans = spark.createDataFrame([("a", 3), ("dry", 2)], "run_id string, steps_planned int")
    got = {r.run_id: (r.ok_count, r.error_count, r.steps_returned, r.steps_planned, r.has_errors)
           for r in runlog.run_summary(steps, plans).collect()}
    assert got == {"a": (1, 1, 2, 3, True), "dry": (0, 0, 0, 2, False)}


def test_models_from_latest_stored_runs(spark):
    from conftest import SAMPLE
    from tillcast.operators.models import fit_average, fit_trend

    sales = [{"date": f"2025-01-{i + 1:02d}", "daily_sales_total": a} for i, a in enumerate(SAMPLE)]
    text = [{"date": "2025-01-01", "daily_sales_total": "5"}]
    df = runs(spark, [
        {"results": [step([A])]},  # the default tenant
        {"result": {"results": [step(sales, restaurant_id="r")]}},
        {"results": [step([], restaurant_id="r")]},  # newer, but without usable sales: passed over
        {"results": [step(text, restaurant_id="r")]},
        {"results": [step([7, *sales], restaurant_id="s")]},  # strict reading refuses it, lenient reading drops the 7
    ])
    strict, lenient = runlog.latest_stored_sales(df), runlog.latest_stored_sales(df, strict=False)
    assert {r.restaurant_id: float(r.avg_daily_sales) for r in fit_average(strict).collect()} == {"restaurant_001": float(A["daily_sales_total"]), "r": 1519.0}
    trend = {r.restaurant_id: (round(r.slope, 6), r.rows) for r in fit_trend(lenient).collect()}
    assert trend["r"] == trend["s"] == (14.339394, 10)
    assert {r.restaurant_id for r in strict.select("restaurant_id").distinct().collect()} == {"restaurant_001", "r"}


def test_percentile_is_exact_and_keeps_no_values(spark):
    import numpy as np
    from plan_text import formatted

    rng = np.random.default_rng(1)
    rows = [(f"s{s}", "step_done", int(ms)) for s, n in ((1, 1), (2, 2), (3, 997)) for ms in rng.integers(0, 90, n)]
    rows += [("s1", "step_start", 10**6), ("s9", "step_done", None)]
    df = spark.createDataFrame(rows, "step string, event string, duration_ms bigint")
    got = runlog.step_durations(df)
    for r in got.collect():
        values = [ms for s, e, ms in rows if s == r.step and e == "step_done"]
        assert (r.runs, r.max_ms) == (len(values), max(values))
        assert abs(r.p95_ms - np.percentile(values, 95)) < 1e-9 and abs(r.avg_ms - np.mean(values)) < 1e-9
    assert got.count() == 3 and "ObjectHashAggregate" not in formatted(got)


def test_tenant_filter_reaches_the_scan(spark, tmp_path):
    from plan_text import pushed_filters

    path = str(tmp_path / "runs")
    rows = [(1, "r", "l"), (2, "r", "m")]
    spark.createDataFrame(rows, "seq bigint, restaurant_id string, location_id string").write.parquet(path)
    found = runlog.latest_run(runlog.runs_of_tenant(spark.read.parquet(path), "r", "m"))
    assert "EqualTo(restaurant_id,r)" in pushed_filters(found) and found.first().seq == 2
