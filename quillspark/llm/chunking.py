"""Problem 2: items over a size limit are cut into overlapping pieces at natural boundaries.

Recursive separator hierarchy: a text is split by section, paragraph, sentence, word and at last by character, each
level only where the one above leaves a unit that is too long; the units are packed greedily up to the limit, and each
piece repeats about ``overlap`` characters of the piece before.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 1200, 150

#: A unit ends where one of these matches ends, from the coarsest to the finest.
SEPARATORS = (
    re.compile(r"\f+|\n(?=#{1,6} )|\n{3,}"),
    re.compile(r"\n[ \t]*\n\s*"),
    re.compile(r"(?<=[.!?…。！？])[\"'»”’)\]]*\s+"),
    re.compile(r"\s+"),
)


def _units(text: str, start: int, end: int, most: int, level: int) -> Iterator[int]:
    """Ends of the units of text[start:end], none longer than most."""
    if end - start <= most:
        yield end
        return
    if level == len(SEPARATORS):
        while end - start > most:
            cut = start + most
            while cut > start + 1 and unicodedata.combining(text[cut]):
                cut -= 1
            yield cut
            start = cut
        yield end
        return
    at = start
    for m in SEPARATORS[level].finditer(text, start, end):
        if at < m.end() < end:
            yield from _units(text, at, m.end(), most, level + 1)
            at = m.end()
    yield from _units(text, at, end, most, level + 1)


def split_spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece of text; spans overlap, cover the text and are at most limit long.

    A text within the limit is one piece; the empty text has none.
    """
    if limit < 2 or not 0 <= overlap < limit:
        raise ValueError("limit must be at least 2 and overlap within 0 and limit - 1")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    spans, start, end = [], 0, 0
    for unit_end in _units(text, 0, len(text), limit - overlap, 0):
        if unit_end - start > limit and end > start:
            spans.append((start, end))
            back = max(start + 1, end - overlap)
            snap = re.compile(r"\s\S").search(text, back - 1, min(end, back + overlap // 3)) if overlap else None
            start = snap.end() - 1 if snap else (back if overlap else end)
        end = unit_end
    spans.append((start, end))
    return spans


def split_oversized(df: DataFrame, key: str = "chunk_id", text: str = "content", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """One row per piece of each text longer than limit: key, piece_index, piece_count, start, content, char_count.

    Null, empty and short texts give no row, whatever a stored length says; equal keys are cut one by one; other
    columns of df aren't read. Texts are filtered in the JVM, so only oversized ones reach Python, and pieces leave it
    as rows, so one very long text never becomes one wide row.
    """
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for k, t in zip(pdf["k"], pdf["t"]):
                spans = split_spans(t, limit, overlap)
                yield pd.DataFrame({
                    key: k, "piece_index": range(len(spans)), "piece_count": len(spans), "start": [a for a, _ in spans],
                    "content": [t[a:b] for a, b in spans], "char_count": [b - a for a, b in spans],
                })

    big = df.where(F.char_length(F.col(text)) > limit).select(F.col(key).alias("k"), F.col(text).alias("t"))
    return big.mapInPandas(cut, f"`{key}` {kind}, piece_index int, piece_count int, start int, content string, char_count int")
