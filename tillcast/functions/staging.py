"""Keeping costly expressions from being evaluated more than once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, keep: list[str], columns: dict[str, Column]) -> DataFrame:
    """The kept columns and the computed ones, each computed a single time per row.

    The optimizer moves a later filter below a projection by writing the column's expression into
    it, and so evaluates a parsed column in the filter and again in the projection. A one-row
    ``inline`` is a boundary it does not move filters across.
    """
    entry = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*keep, F.inline(F.array(entry)))
