"""Text and Markdown files as chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST, OVERLAP, LEAST = 1200, 150, 64
_STOPS = ".!?\n "
_HEADING = re.compile(r"^#{1,6}\s+(.*\S)\s*$", re.M)


def chunk(text: str, most: int = MOST, overlap: int = OVERLAP) -> list[str]:
    """Pieces of at most most characters, trimmed, without empty ones.

    Each ends after the last full stop, mark, line break or blank in its second half, if there is one, and begins
    overlap characters (at most half of most) before the end of the one before.
    """
    most = max(LEAST, most)
    overlap = min(overlap, most // 2)
    out, start = [], 0
    while start < len(text):
        end = min(len(text), start + most)
        if end < len(text):
            cut = max(text.rfind(c, start + most // 2, end) for c in _STOPS)
            end = cut + 1 if cut >= 0 else end
        if piece := text[start:end].strip():
            out.append(piece)
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def sections(text: str) -> list[tuple[str | None, str]]:
    """(heading, text) of a Markdown text; what stands before the first heading has none."""
    out, at, heading = [], 0, None
    for m in _HEADING.finditer(text):
        if text[at : m.start()].strip():
            out.append((heading, text[at : m.start()]))
        at, heading = m.end(), m.group(1)
    if text[at:].strip():
        out.append((heading, text[at:]))
    return out


SCHEMA = "chunk_id long, source string, page int, chunk_index int, heading string, content string, char_count int"


def read_text(spark: SparkSession, pattern: str, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """chunk_id, source, page (1), chunk_index, heading, content, char_count of the files, a file at a time in a task.

    Files ending in .md are cut at their headings first. chunk_id is unique and grows with the source and the index.
    """
    from quillspark.sources.files import discover

    files = discover(pattern)
    whole = spark.read.text(files, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "/").alias("source"), "value")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for source, text in zip(pdf["source"], pdf["value"]):
                parts = sections(text) if source.lower().endswith((".md", ".markdown")) else [(None, text)]
                rows = [(h, c) for h, t in parts for c in chunk(t, most, overlap)]
                yield pd.DataFrame({"chunk_id": 0, "source": source, "page": 1, "chunk_index": range(len(rows)), "heading": [h for h, _ in rows], "content": [c for _, c in rows], "char_count": [len(c) for _, c in rows]})

    chunks = whole.mapInPandas(cut, SCHEMA)
    order = spark.createDataFrame([(f, i) for i, f in enumerate(files)], "source string, n long")  # one row a file
    return chunks.join(F.broadcast(order), "source").select((F.col("n") * (1 << 32) + F.col("chunk_index")).alias("chunk_id"), "source", "page", "chunk_index", "heading", "content", "char_count")


def chunk_column(df: DataFrame, key: str, text: str, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, content, char_count of a text column's chunks; null and blank texts give none."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([chunk(t, most, overlap) if t else [] for t in s])

    return df.select(key, F.posexplode(cut(F.col(text))).alias("chunk_index", "content")).withColumn("char_count", F.length("content"))


def chunk_graph(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a chunk table: one node per heading and chunk, an edge from each heading to its chunks."""
    title = F.concat_ws("#", "source", "heading")
    heads = chunks.where("heading is not null").select(F.xxhash64(title).alias("id"), F.lit("Heading").alias("label"), F.to_json(F.struct("source", "heading")).alias("properties")).distinct()
    parts = chunks.select(F.col("chunk_id").alias("id"), F.lit("Chunk").alias("label"), F.to_json(F.struct("source", "chunk_index", "content")).alias("properties"))
    edges = chunks.where("heading is not null").select(F.xxhash64(title).alias("src"), F.col("chunk_id").alias("dst"), F.lit("HAS").alias("label"), F.lit(1.0).alias("weight"), F.lit("{}").alias("properties"))
    return heads.unionByName(parts), edges
