"""Aggregates whose rules differ from the built-in ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _finite(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def stddev(col: str | Column) -> Column:
    """Sample standard deviation of the finite values; null for fewer than two."""
    return F.stddev_samp(_finite(col))


def percentile(col: str | Column, q: float = 0.5) -> Column:
    """Exact percentile with linear interpolation; q is clamped to 0..1."""
    return F.percentile(col, min(1.0, max(0.0, q)))


def first_per_group(df: DataFrame, keys: list[str], order: str, columns: dict[str, str]) -> DataFrame:
    """The columns {alias: name} of the row with the least order in each group, by partial aggregation; nulls in keys are a group."""
    row = F.struct(*(F.col(c).alias(a) for a, c in columns.items()))
    return df.groupBy(*keys).agg(F.min_by(row, F.col(order)).alias("_row")).select(*keys, *(F.col(f"_row.{a}").alias(a) for a in columns))
