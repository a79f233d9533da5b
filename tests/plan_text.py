"""Physical plans as text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame


def formatted(df: DataFrame) -> str:
    spark = df.sparkSession
    kept = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    try:
        return df._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
        )
    finally:
        spark.conf.set("spark.sql.maxMetadataStringLength", kept)


def pushed_filters(df: DataFrame) -> str:
    return " ".join(re.findall(r"PushedFilters: \[(.*)\]", formatted(df)))


def nodes(df: DataFrame, name: str) -> int:
    """How often an operator occurs in the plan tree."""
    tree = formatted(df).split("\n\n")[0]
    return len(re.findall(rf"[-+ *] {name} ", tree))
