"""Time the queries over large and skewed copies of the tables: python scale_run.py SF_DIR OUT_DIR [MILLION_ROWS].

Writes ``orders`` and ``events`` with that many million rows, a third of them under one key, beside links
to the other tables, and runs every query over orders, events and customers once with broadcasts off.
"""

from __future__ import annotations

import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tillcast.plans.catalog import QUERIES
from tillcast.session import local_session


def build(spark: SparkSession, sf_dir: str, out: str, rows: int) -> None:
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    n = F.col("id")
    hot = n % 3 == 0
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.xxhash64("id") % 1200).cast("int"))
    orders = spark.range(rows).select(
        n.alias("o_orderkey"),
        F.when(hot, F.lit(1)).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(customers)) + 1).alias("o_custkey"),
        (F.pmod(F.xxhash64("id", F.lit(2)), F.lit(50_000_000)) / 100).alias("o_totalprice"),
        day.cast("timestamp").alias("o_orderdate"),
    )
    kinds = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    events = spark.range(rows).select(
        n.alias("event_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + n).alias("ts"),
        F.when(hot, F.lit(1)).otherwise(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1_000_000))).alias("user_id"),
        F.element_at(kinds, (F.pmod(F.xxhash64("id", F.lit(4)), F.lit(5)) + 1).cast("int")).alias("event_type"),
        (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(20_000)) / 100).alias("value"),
        F.format_string('{"k": %d}', n % 100).alias("props"),
    )
    os.makedirs(out)
    orders.write.parquet(f"{out}/orders.parquet")
    events.write.parquet(f"{out}/events.parquet")
    for name in os.listdir(sf_dir):
        if not os.path.exists(f"{out}/{name}"):
            os.symlink(f"{sf_dir}/{name}", f"{out}/{name}")


def main(sf_dir: str, out: str, millions: float = 20) -> None:
    spark = local_session(cores=8, shuffle_partitions=32, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    build(spark, sf_dir, out, int(millions * 1_000_000))
    for name, query in QUERIES.items():
        start = time.perf_counter()
        query(spark, out).write.format("noop").mode("overwrite").save()
        print(f"| `{name}` | {time.perf_counter() - start:.1f} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(float, sys.argv[3:]))
