"""Recursive queries that end when no new row appears."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quillspark.session import checkpointed

MOST_ROUNDS = 10_000


def union_fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """The rows of seed and all that step derives from new rows, each once; cycles end by themselves.

    Each round only reads what the round before added. Nulls count as equal. The lineage is cut each round.
    """
    new = checkpointed(seed.distinct())
    parts = [new]
    for _ in range(most_rounds):
        known = parts[0]
        for p in parts[1:]:
            known = known.unionAll(p)
        found = step(new)
        found = found.toDF(*seed.columns)
        new = checkpointed(found.subtract(known))
        if new.isEmpty():
            return known
        parts.append(new)
        if len(parts) > 8:
            parts = [checkpointed(known.unionAll(new))]
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")
