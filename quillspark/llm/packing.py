"""Problem 8: items are packed into containers of fixed capacity.

Vector best-fit, decreasing: a container has three capacities, tokens, documents and attention cost (the sum of the
squared item lengths); an item goes to the open container that can take it under every constraint and keeps the least
weighted residual norm, else to a new one. An item is split only if it alone exceeds the capacity.

The items are dealt by hash to groups of about ``group_items``; each group is packed on its own, so no task holds more
than that, whatever the table's size. Containers that a group leaves under ``reopen_below`` full are dissolved, and
their items, a few containers a group, are packed again together in the same way.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import VOCABULARY, with_tokens

CAPACITY, MAX_ITEMS, GROUP_ITEMS, REOPEN_BELOW = 2048, 512, 8000, 0.97
WEIGHTS = (1.0, 0.05, 0.05)
#: Limits for training with few documents a container and a bounded cost of attention across them: with these all three capacities bind.
BOUNDED = {"max_items": 12, "max_attention": CAPACITY * CAPACITY // 2}


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY, max_items: int = MAX_ITEMS, max_attention: int | None = None, weights: tuple = WEIGHTS) -> np.ndarray:
    """The container number of each item; sizes must not exceed capacity. Ties go to the container opened first."""
    n, most = len(sizes), max_attention or capacity * capacity
    out = np.full(n, -1, "i8")
    order = np.argsort(-sizes, kind="stable")
    room = np.zeros((max(16, n), 3))
    room_ids, open_n, made = np.zeros(max(16, n), "i8"), 0, 0
    unit, w = np.array([capacity, max_items, most], float), np.array(weights)
    least = float(sizes.min()) if n else 0.0
    for i in order:
        need = np.array([sizes[i], 1, float(sizes[i]) ** 2])
        left = room[:open_n] - need
        fits = (left[:, 0] >= 0) & (left[:, 1] >= 0) & (left[:, 2] >= 0)
        at = np.flatnonzero(fits)
        if len(at):
            rest = left[at] / unit
            b = at[np.argmin((rest * rest) @ w)]
        else:
            b, open_n = open_n, open_n + 1
            room[b], room_ids[b], made = unit, made, made + 1
        room[b] -= need
        out[i] = room_ids[b]
        if room[b, 0] < least or room[b, 1] < 1:  # nothing fits any more: the last open one takes its place
            open_n -= 1
            room[b], room_ids[b] = room[open_n], room_ids[open_n]
    return out


def _pack_groups(items: DataFrame, key_type: str, capacity: int, max_items: int, round_no: int, max_attention: int | None, tasks: int) -> DataFrame:
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "doc_key", "piece_index"], ascending=[False, True, True], kind="stable")
        k = best_fit(pdf["tokens"].to_numpy(), capacity, max_items, max_attention)
        fill = np.bincount(k, weights=pdf["tokens"], minlength=1)
        return pdf.assign(container=pdf["grp"].astype(str) + f".{round_no}." + pd.Series(k, index=pdf.index).astype(str), fill=fill[k])

    # A task a group: so many partitions are asked for by number, and not joined again because they are small.
    return items.repartition(max(1, tasks), "grp").groupBy("grp").applyInPandas(pack, f"doc_key {key_type}, piece_index int, piece_count int, start long, tokens long, grp long, container string, fill double")


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = VOCABULARY, capacity: int = CAPACITY, max_items: int = MAX_ITEMS, group_items: int = GROUP_ITEMS, reopen_below: float = REOPEN_BELOW, max_attention: int | None = None) -> DataFrame:
    """One row per packed piece: key, piece_index, piece_count, start (in tokens), tokens, container, fill.

    A null or empty text is an item of no tokens, packed like any other; a text of more than capacity tokens becomes
    full pieces, each a container of its own, and a rest that is packed. An empty table gives no rows. A piece that
    alone costs more than max_attention has a container of its own; without max_attention tokens bind first.
    """
    kind = df.schema[key].dataType.simpleString()
    groups = max(1, -(-df.count() // group_items))
    sized = with_tokens(df, [key], text, path).withColumnRenamed(key, "doc_key")
    pieces = F.greatest(F.ceil(F.col("tokens") / capacity), F.lit(1)).cast("int")
    cut = (
        sized.select("doc_key", "tokens", pieces.alias("piece_count"))
        .select("doc_key", "piece_count", F.explode(F.sequence(F.lit(0), F.col("piece_count") - 1)).alias("piece_index"), F.col("tokens").alias("total"))
        .select(
            "doc_key", "piece_index", "piece_count", (F.col("piece_index").cast("long") * capacity).alias("start"),
            F.least(F.lit(capacity).cast("long"), F.col("total") - F.col("piece_index").cast("long") * capacity).alias("tokens"),
            F.pmod(F.xxhash64("doc_key", "piece_index"), F.lit(groups)).alias("grp"),
        )
    )
    first = _pack_groups(cut, kind, capacity, max_items, 1, max_attention, groups)
    last = F.col("fill") < capacity * reopen_below
    again = groups > 1
    if again:
        from quillspark.session import checkpointed

        first = checkpointed(first)
        loose = first.where(last).drop("container", "fill")
        fewer = max(1, -(-loose.count() // group_items))
        packed = _pack_groups(loose.withColumn("grp", F.pmod(F.xxhash64("doc_key", "piece_index"), F.lit(fewer))), kind, capacity, max_items, 2, max_attention, fewer)
        first = first.where(~last).unionByName(packed)
    return first.select(F.col("doc_key").alias(key), "piece_index", "piece_count", "start", "tokens", "container", "fill")


def containers(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per container of pack_documents: container, n_items, tokens, unused."""
    return packed.groupBy("container").agg(F.count(F.lit(1)).alias("n_items"), F.sum("tokens").alias("tokens")).withColumn("unused", F.lit(capacity) - F.col("tokens"))
