"""Exact facts in place of approximate ones at the same range."""

from __future__ import annotations

from pyspark.sql import DataFrame

RANGE = ["source_unit_id", "start_byte", "end_byte", "kind"]


def enriched(approximate: DataFrame, exact: DataFrame, key: list[str] | None = None) -> DataFrame:
    """exact, and the approximate rows whose range no exact row has."""
    return approximate.join(exact.select(*(key or RANGE)).distinct(), key or RANGE, "left_anti").select(*exact.columns).unionByName(exact)


def overlaid(first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value) of both; first wins."""
    from pyspark.sql import functions as F

    both = first.select(key, F.col(value).alias("_a")).join(second.select(key, F.col(value).alias("_b")), key, "full")
    return both.select(key, F.coalesce("_a", "_b").alias(value))
