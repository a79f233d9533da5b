from __future__ import annotations

import random

from tillcast.constants import STEP_NAMES
from tillcast.operators import requests

SCHEMA = "request_id bigint, steps string, exclude_steps string, start_at string, stop_after string, strict string"


def expected(row, known):
    """The rules written out for one request."""
    _, steps, exclude, start, stop, strict = row
    names = [p.strip() for p in (steps or "").split(",") if p.strip()]
    out = [p.strip() for p in (exclude or "").split(",") if p.strip()]
    start, stop = (start or "").strip(), (stop or "").strip()
    unique = lambda values: list(dict.fromkeys(values))
    plan = unique(n for n in names if n in known) if names else list(known)
    bad = unique(n for n in names if n not in known)
    bad_selectors = unique(n for n in [start, stop, *out] if n and n not in known)
    is_strict = (strict or "").strip().lower() not in {"0", "false", "no", "n", "off"}
    if is_strict and (bad or bad_selectors):
        return plan, bad, bad_selectors, "unknown_steps" if bad else "unknown_selectors"
    plan = [n for n in plan if n not in out]
    if start in plan:
        plan = plan[plan.index(start):]
    if stop in plan:
        plan = plan[: plan.index(stop) + 1]
    return plan, bad, bad_selectors, "unknown_values_ignored" if bad or bad_selectors else "ok"


def test_audit_equals_rules(spark):
    rng = random.Random(5)
    names = [*STEP_NAMES[:5], "bogus", "nope"]

    def some(n):
        return rng.choice(["", " ", None, ",".join(rng.choice([" ", ""]) + rng.choice(names) for _ in range(n))])

    rows = [
        (i, some(rng.randrange(1, 7)), some(2), rng.choice(["", None, *names]), rng.choice(["", None, *names]),
         rng.choice(["yes", "no", "OFF", "", None, "maybe"]))
        for i in range(400)
    ]
    got = requests.audit_requests(spark.createDataFrame(rows, SCHEMA)).collect()
    by_id = {r.request_id: r for r in got}
    for row in rows:
        plan, bad, bad_selectors, verdict = expected(row, STEP_NAMES)
        r = by_id[row[0]]
        assert (r.plan, r.unknown_steps, r.unknown_selectors, r.verdict) == (plan, bad, bad_selectors, verdict), row
        assert r.steps_planned == len(plan)


def test_step_counts(spark):
    rows = [(1, "a, b,a", "", "", "", ""), (2, "b,x", "", "", "", ""), (3, " ", "", "", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([("a",), ("b",)], "step string")
    assert {tuple(r) for r in requests.known_step_counts(df, known).collect()} == {("a", 2), ("b", 2)}
    assert {tuple(r) for r in requests.unknown_step_counts(df, known).collect()} == {("x", 1)}
