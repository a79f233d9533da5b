from __future__ import annotations

import random
from datetime import date
from decimal import Decimal

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tillcast.operators import ingest

RAW = "ingest_seq bigint, batch bigint, restaurant_id string, location_id string, date_text string, sales_text string"
D = "2025-01-0"


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_validation_reasons_in_order(spark):
    rows = [
        (1, 0, "r", "l", "bad", "abc"),
        (2, 0, "r", "l", D + "1", "abc"),
        (3, 0, "r", "l", D + "1", "-1"),
        (4, 0, "r", "l", D + "1", "nan"),
        (5, 0, "", None, D + "1", "10"),
        (6, 0, "r", "l", None, "10"),
        (7, 0, "r", "l", D + "1", "1e300"),
        (8, 0, "r", "l", D + "1", "-0.001"),
        (9, 0, "r", "l", D + "1", "-0"),
    ]
    out = {r.ingest_seq: r for r in ingest.classify_uploads(raw(spark, rows)).collect()}
    assert [out[i].reason for i in range(1, 10)] == [
        "invalid_date", "invalid_sales", "negative_sales", "invalid_sales", None, "invalid_date",
        "invalid_sales", "negative_sales", None,
    ]
    assert (out[5].restaurant_id, out[5].location_id) == ("restaurant_001", "location_001")


def test_split_is_complete(spark):
    rows = [(i, 0, "r", "l", D + "1", "5" if i % 2 else "x") for i in range(10)]
    classified = ingest.classify_uploads(raw(spark, rows))
    good, bad = ingest.accepted_rows(classified), ingest.rejected_rows(classified)
    assert (good.count(), bad.count()) == (5, 5)
    assert {r.reason for r in bad.collect()} == {"invalid_sales"}


def brute_force(rows):
    """Row by row, as an upload of one row after the other."""
    state, counts = {}, {}
    for seq, batch, r, l, day, amount in sorted(rows, key=lambda x: (x[1], x[0])):
        c = counts.setdefault(batch, [0, 0, 0])
        if amount == "x":
            c[2] += 1
            continue
        key = (r, l, day)
        c[1 if key in state else 0] += 1
        state[key] = Decimal(amount)
    return state, {b: tuple(c) for b, c in counts.items()}


def as_state(df):
    return {(r.restaurant_id, r.location_id, str(r.date)): r.daily_sales_total for r in df.collect()}


def as_counts(df):
    return {r.batch: (r.inserted, r.updated, r.skipped) for r in df.collect()}


def random_rows(seed, n, hot=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot_row = rng.random() < hot
        rows.append((
            i, rng.randrange(4), "r0" if hot_row else f"r{rng.randrange(3)}", "l0",
            D + "1" if hot_row else D + str(rng.randrange(1, 6)),
            rng.choice(["x", f"{rng.randrange(1000)}.25"]),
        ))
    rng.shuffle(rows)
    return rows


def test_state_and_counts_equal_row_by_row(spark):
    for seed, hot in ((1, 0.0), (2, 0.4), (3, 0.9)):
        rows = random_rows(seed, 300, hot)
        state, counts = brute_force(rows)
        classified = ingest.classify_uploads(raw(spark, rows).repartition(7))
        assert as_state(ingest.latest_by_key(ingest.accepted_rows(classified))) == state
        assert as_counts(ingest.upsert_counts(classified)) == counts


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10_000))
def test_counts_add_up_and_state_is_idempotent(spark, seed):
    rows = random_rows(seed, 60)
    classified = ingest.classify_uploads(raw(spark, rows))
    totals = as_counts(ingest.upsert_counts(classified))
    for batch, (inserted, updated, skipped) in totals.items():
        assert inserted + updated + skipped == sum(1 for r in rows if r[1] == batch)
    upload = ingest.accepted_rows(classified)
    once = ingest.upsert_sales(ingest.latest_by_key(upload).limit(0), upload.withColumnRenamed("ingest_seq", "s"), "s")
    twice = ingest.upsert_sales(once, upload.withColumnRenamed("ingest_seq", "s"), "s")
    assert as_state(once) == as_state(twice)


def test_upsert_sales_overrides_only_uploaded_keys(spark, make_sales):
    current = make_sales({("r", "l"): [1, 2, 3]})
    upload = spark.createDataFrame(
        [("r", "l", date(2025, 1, 2), Decimal("20.00"), 1), ("r", "l", date(2025, 1, 2), Decimal("21.00"), 2),
         ("r", "l", date(2025, 1, 9), Decimal("9.00"), 3)],
        "restaurant_id string, location_id string, date date, daily_sales_total decimal(18,2), ingest_seq bigint",
    )
    got = {k[2]: str(v) for k, v in as_state(ingest.upsert_sales(current, upload)).items()}
    assert got == {"2025-01-01": "1.00", "2025-01-02": "21.00", "2025-01-03": "3.00", "2025-01-09": "9.00"}


def test_count_against_stored_keys(spark, make_sales):
    current = make_sales({("r", "l"): [1]}).select("restaurant_id", "location_id", "date")
    rows = [(1, 1, "r", "l", D + "1", "5"), (2, 1, "r", "l", D + "2", "5"), (3, 1, "r", "l", D + "2", "6"),
            (4, 1, "r", "l", D + "2", "x")]
    got = ingest.count_against(current, ingest.classify_uploads(raw(spark, rows))).first()
    assert (got.inserted, got.updated, got.skipped) == (1, 2, 1)


def test_arrival_order_falls_back_to_struct(spark):
    df = raw(spark, []).selectExpr("batch", "struct(ingest_seq) as s")
    assert "struct" in str(df.select(ingest.arrival_order(df, seq="s")).schema[0].dataType).lower()
