from __future__ import annotations

import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import SAMPLE
from tillcast.operators import forecast as fc
from tillcast.operators import models

T = ("r", "l")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_average_golden(make_sales):
    m = one(models.fit_average(make_sales({T: SAMPLE})))
    assert (m.avg_daily_sales, m.training_rows) == (Decimal("1519.0000"), 10)


def test_average_skips_missing_and_nan(spark, make_sales):
    assert one(models.fit_average(make_sales({T: [10, None, 20]}))).training_rows == 2
    nan = make_sales({T: [10, 20]}).withColumn(
        "daily_sales_total", F.when(F.dayofmonth("date") == 1, F.lit(float("nan"))).otherwise(F.lit(20.0))
    )
    assert one(models.fit_average(nan)).avg_daily_sales == Decimal("20.0000")


def test_trend_golden(make_sales):
    m = one(models.fit_trend(make_sales({T: SAMPLE})))
    assert m.intercept == pytest.approx(1454.4727272727273, rel=1e-12)
    assert m.slope == pytest.approx(14.33939393939394, rel=1e-12)
    assert m.std_error == pytest.approx(57.41820004989446, rel=1e-12)
    assert m.rows == 10


@pytest.mark.parametrize(
    ("amounts", "intercept", "slope"), [([7], 7.0, 0.0), ([5, 5, 5], 5.0, 0.0), ([1, 3], 1.0, 2.0)]
)
def test_trend_edges(make_sales, amounts, intercept, slope):
    m = one(models.fit_trend(make_sales({T: amounts})))
    assert (m.intercept, m.slope, m.std_error) == (intercept, slope, 0.0)


def test_trend_does_not_depend_on_partitioning(make_sales):
    sales = make_sales({("r", str(i)): SAMPLE[i:] for i in range(5)})
    a = sorted(models.fit_trend(sales).collect())
    b = sorted(models.fit_trend(sales.repartition(9)).collect())
    assert a == b


def test_prior_curve(spark):
    ys = [r.y for r in models.prior_curve(spark).orderBy("x").collect()]
    assert len(ys) == 365
    assert ys[0] == 1200.0
    assert ys[1] == pytest.approx(1392.5693097377623, rel=1e-14)
    assert ys[-1] == pytest.approx(1521.7543328797387, rel=1e-14)


def test_cold_start(spark, make_sales):
    tenants = spark.createDataFrame([("r", c) for c in "abcd"], "restaurant_id string, location_id string")
    sales = make_sales({("r", "b"): [7], ("r", "c"): [1, 3], ("r", "d"): [5, 5, 5]})
    got = {r.location_id: r for r in models.fit_trend_with_prior(tenants, sales, spark).collect()}
    for cold in "ab":
        assert got[cold].training_source == "synthetic_fallback"
        assert got[cold].rows == 365
        assert got[cold].intercept == pytest.approx(1205.7616174380967, rel=1e-12)
        assert got[cold].slope == pytest.approx(0.8741461850563539, rel=1e-11)
        assert got[cold].std_error == pytest.approx(194.22746849986825, rel=1e-12)
    assert (got["c"].intercept, got["c"].slope, got["c"].rows) == (1.0, 2.0, 2)
    assert got["d"].training_source == "real_pipeline_sales"


def test_model_status(spark, make_sales):
    tenants = spark.createDataFrame([("r", c) for c in "abc"], "restaurant_id string, location_id string")
    sales = make_sales({("r", "b"): [None], ("r", "c"): [1]})
    got = {r.location_id: tuple(r)[2:] for r in models.model_status(tenants, models.training_outcome(sales)).collect()}
    assert got == {
        "a": ("skipped", "missing_sales_data_from_1_data_ingestion", "error", "model_not_found"),
        "b": ("error", "no_numeric_sales", "error", "invalid_model_format"),
        "c": ("ok", None, "ok", None),
    }


def test_profiles_agree_with_separate_operators(make_sales):
    from tillcast.operators.insight import recent_arrays

    sales = make_sales({("r", str(i)): SAMPLE[i:] for i in range(10)})
    profile = models.tenant_profiles(sales)
    separate = models.fit_average(sales).join(recent_arrays(sales), ["restaurant_id", "location_id"])
    assert sorted(profile.collect()) == sorted(separate.select(*profile.columns).collect())


PLAN = [
    (1, "1549.38", 2, "697.22", "61.98"),
    (2, "1580.37", 2, "711.17", "63.21"),
    (3, "1611.98", 2, "725.39", "64.48"),
    (4, "1644.22", 2, "739.90", "65.77"),
    (5, "1677.10", 2, "754.70", "67.08"),
    (6, "1710.64", 2, "769.79", "68.43"),
    (7, "1744.85", 2, "785.18", "69.79"),
]


def test_forecast_and_plans_golden(make_sales):
    days = fc.forecast(models.fit_average(make_sales({T: SAMPLE})))
    got = [tuple(str(v) if isinstance(v, Decimal) else v for v in r[2:]) for r in
           fc.daily_plan(days).orderBy("day_index").collect()]
    assert got == PLAN
    next_day = one(fc.next_day_prediction(models.fit_average(make_sales({T: SAMPLE}))))
    assert str(next_day.predicted_next_day_sales) == "1549.38"


def test_forecast_rounds_every_day(make_sales):
    days = fc.forecast(models.fit_average(make_sales({T: ["0.37"]})), horizon=30)
    amount, expected = Decimal("0.37"), []
    for _ in range(30):
        amount = (amount * Decimal("1.02")).quantize(Decimal("0.01"), rounding="ROUND_HALF_UP")
        expected.append(amount)
    assert [r.predicted_sales for r in days.orderBy("day_index").collect()] == expected


def test_no_forecast_without_average(make_sales):
    outcome = models.training_outcome(make_sales({T: [None]}))
    assert fc.forecast(outcome).count() == 0


@pytest.mark.parametrize(
    ("amount", "staff"), [("-5", 1), ("0", 1), ("599.99", 1), ("600", 1), ("1199.99", 1), ("1200", 2), ("6000", 10)]
)
def test_staffing_rule(spark, amount, staff):
    got = spark.range(1).select(fc.staff_needed(F.lit(Decimal(amount)).cast("decimal(18,2)"))).first()[0]
    assert got == staff == max(1, math.floor(Decimal(amount) / 600))


def test_plan_forms_agree(make_sales):
    sales = make_sales({("r", str(i)): SAMPLE[i:] for i in range(4)})
    arrays = fc.with_forecast(models.fit_average(sales))
    days = fc.forecast_days(arrays)
    flat = fc.daily_plan(days)
    joined = fc.join_plans(days, fc.staffing_plan(days), fc.inventory_plan(days))
    assert sorted(flat.collect()) == sorted(joined.select(*flat.columns).collect())
    nested = fc.nest_plans(flat)
    assert sorted(nested.collect()) == sorted(fc.nest_forecast(arrays).select(*nested.columns).collect())


@pytest.mark.parametrize(("amounts", "first", "staff"), [([0, 0], "0.00", 1), ([-100, -50], "-76.50", 1), (["-0.75"], "-0.77", 1)])
def test_average_of_zero_or_less(make_sales, amounts, first, staff):
    row = fc.daily_plan(fc.forecast(models.fit_average(make_sales({T: amounts})))).orderBy("day_index").first()
    assert (str(row.predicted_sales), row.recommended_staff) == (first, staff)


def test_results_do_not_depend_on_partitioning(make_sales):
    sales = make_sales({("r", str(i)): SAMPLE[i:] for i in range(6)})
    for build in (models.tenant_profiles, models.fit_average, models.training_outcome):
        assert sorted(build(sales.repartition(7)).collect()) == sorted(build(sales.coalesce(1)).collect())
