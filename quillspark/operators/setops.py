"""Compound queries in the order in which they are written, with equal precedence."""

from __future__ import annotations

from pyspark.sql import DataFrame


def compound(first: DataFrame, *parts: tuple[str, DataFrame]) -> DataFrame:
    """first, combined left-deep with each (union, union all, intersect or except; table); columns go by position."""
    out = first
    for kind, df in parts:
        match kind.lower():
            case "union":
                out = out.union(df).distinct()
            case "union all":
                out = out.union(df)
            case "intersect":
                out = out.intersect(df)
            case "except":
                out = out.subtract(df)
            case _:
                raise ValueError(f"unknown set operation: {kind}")
    return out
