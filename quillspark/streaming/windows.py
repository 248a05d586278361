"""Event-time windows over streams and tables alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(df: DataFrame, time: str, width: str, keys: list[str], aggregates: list, late: str | None = None, slide: str | None = None) -> DataFrame:
    """window_start, window_end, keys and aggregates of windows of a width; late is how late rows may come to a stream."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(w.alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def sessions(df: DataFrame, time: str, gap: str, keys: list[str], aggregates: list, late: str | None = None) -> DataFrame:
    """Like tumbling, for sessions that end after a gap."""
    rows = df.withWatermark(time, late) if late and df.isStreaming else df
    out = rows.groupBy(F.session_window(time, gap).alias("_w"), *keys).agg(*aggregates)
    return out.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *[c for c in out.columns if c != "_w"])


def upsert_stream(stream: DataFrame, store, table: str, checkpoint: str):
    """Writes each batch of a stream into a table by its primary key; the query started. A batch given twice has no further effect."""

    def put(batch: DataFrame, _: int) -> None:
        store.insert(table, batch, "replace")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("append")
