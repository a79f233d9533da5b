from __future__ import annotations

import pytest

import __spark_entry__ as contract
from oracle_check import compare, connect
from tillcast.plans.catalog import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def duck(sf_oracle):
    con = connect(sf_oracle)
    yield con
    con.close()


def test_every_query_has_sql():
    assert set(QUERIES) <= set(contract.queries()) and set(QUERIES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf_oracle, name):
    query, sql = contract.queries()[name], contract.oracle_sql()[name]
    assert compare(spark, duck, name, query, sql, sf_oracle) is None


def test_entry(spark, sf_small):
    df = contract.entry(spark)
    assert df.columns[:3] == ["restaurant_id", "location_id", "day_index"]
    assert df.count() == 93 * 7


# Counts stated for these inputs when the relations were designed.
def test_expected_counts(spark, sf_oracle):
    q = contract.queries()
    reasons = {r.reason: r.n for r in q["upload_validation"](spark, sf_oracle).groupBy("reason").count()
               .withColumnRenamed("count", "n").collect()}
    assert reasons == {None: 11597, "invalid_date": 1364, "invalid_sales": 1366, "negative_sales": 673}
    counts = {r.batch: tuple(r)[1:] for r in q["upload_counts"](spark, sf_oracle).collect()}
    assert counts[1] == (5640, 160, 1700)
    assert q["upload_upsert"](spark, sf_oracle).count() == 11368
    files = {r.sales_source: r.n for r in q["upload_file_verdict"](spark, sf_oracle).groupBy("sales_source")
             .count().withColumnRenamed("count", "n").collect()}
    assert files == {"csv_file": 2372, "simulated_fallback": 1378}
