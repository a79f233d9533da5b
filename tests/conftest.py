from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from tillcast.session import local_session  # noqa: E402

DATA = os.environ.get("TEST_DATA_DIR", "/root/testdata")

SAMPLE = [1420, 1398, 1510, 1605, 1588, 1499, 1522, 1478, 1550, 1620]


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, shuffle_partitions=4, memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_small():
    path = f"{DATA}/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


@pytest.fixture(scope="session")
def sf_oracle():
    path = f"{DATA}/sf0.01"
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path


SALES_SCHEMA = "restaurant_id string, location_id string, date date, daily_sales_total decimal(18,2)"


@pytest.fixture
def make_sales(spark):
    """Keyed sales rows from ``{(restaurant, location): [amounts]}``, one per day from 2025-01-01."""
    from datetime import date, timedelta
    from decimal import Decimal

    def build(series: dict[tuple[str, str], list]):
        rows = [
            (r, l, date(2025, 1, 1) + timedelta(days=i), Decimal(str(a)) if a is not None else None)
            for (r, l), amounts in series.items()
            for i, a in enumerate(amounts)
        ]
        return spark.createDataFrame(rows, SALES_SCHEMA)

    return build
