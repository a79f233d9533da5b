"""Shape of the physical plans."""

from __future__ import annotations

import pytest

from plan_text import formatted, nodes
from tillcast.plans.catalog import QUERIES

PYTHON_NODES = ["MapInPandas", "BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInArrow"]
NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def plans(spark, sf_small):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        built = {}
        for name, query in QUERIES.items():
            df = query(spark, sf_small)
            text = formatted(df)
            built[name] = (df, text, text.split("\n\n")[0])
        yield built
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", NAMES)
def test_no_python(plans, name):
    assert not [n for n in PYTHON_NODES if n in plans[name][2]]


@pytest.mark.parametrize("name", NAMES)
def test_no_products_and_no_forced_broadcasts(plans, name):
    tree = plans[name][2]
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BroadcastHashJoin"):
        assert node not in tree


READ_ORDERS_ONCE = ["daily_sales", "dashboard", "forecast_7d", "forecast_current_or_recomputed", "insight_prompt",
                    "model_status", "recent_sales", "trend_model", "trend_model_cold_start", "upload_against_table",
                    "upload_applied_to_table", "upload_counts", "upload_upsert"]


@pytest.mark.parametrize("name", READ_ORDERS_ONCE)
def test_orders_are_read_once(plans, name):
    details = [p.strip() for p in plans[name][1].split("\n\n")]
    scans = [p for p in details if "Scan parquet" in p.split("\n")[0] and "/orders.parquet" in p]
    assert len(scans) == 1
    assert "o_orderpriority" not in scans[0] and "o_orderstatus" not in scans[0]


@pytest.mark.parametrize("name", ["insight_parse", "run_request_audit", "run_sales_extract", "step_output_normalise",
                                  "step_payload_coerce", "run_tenants"])
def test_row_local_queries_do_not_shuffle(plans, name):
    assert "Exchange" not in plans[name][2]


@pytest.mark.parametrize("name", ["upload_upsert", "upload_applied_to_table", "latest_run"])
def test_latest_row_aggregate_stays_in_a_hash_table(plans, name):
    assert "SortAggregate" not in plans[name][2]


def test_recent_sales_cut_rows_before_the_shuffle(plans):
    assert nodes(plans["recent_sales"][0], "WindowGroupLimit") == 2


def test_one_tenant_shuffle_after_daily_totals(plans):
    for name in ("trend_model", "dashboard"):
        joins = 4  # orders, customer, nation and their join
        assert nodes(plans[name][0], "Exchange") == joins + 2
