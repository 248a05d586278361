"""Window helpers: standard rules by default, the whole-partition rules with compat."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def whole_partition(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def ntile(n: int, keys: list[str], order: list[str], compat: bool = False) -> Column:
    """Tile of each row; compat gives floor(position * n / rows) + 1 instead of the standard tiles."""
    w = Window.partitionBy(*keys).orderBy(*order)
    if not compat:
        return F.ntile(n).over(w)
    place = (F.row_number().over(w).cast("long") - 1) * n
    return F.floor(place / F.count(F.lit(1)).over(Window.partitionBy(*keys))).cast("long") + 1


def compat_sum(col: str, keys: list[str]) -> Column:
    """Sum over the whole partition, 0 where there is no value."""
    return F.coalesce(F.sum(col).over(whole_partition(keys)), F.lit(0))
