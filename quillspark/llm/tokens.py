"""Token counts with a public tokenizer's vocabulary file."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level BPE vocabularies split a text before merging.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longest part given to the encoder at once; a part ends before white space, where the split pattern ends a word anyway.
PART = 1 << 16


@functools.cache
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: str | None, path: str = VOCABULARY) -> int:
    """Tokens of a whole text; null and empty texts have none."""
    if not text:
        return 0
    encode, n, at = encoder(path).encode_ordinary, 0, 0
    while len(text) - at > PART:
        cut = max(text.rfind(" ", at + PART // 2, at + PART), text.rfind("\n", at + PART // 2, at + PART))
        cut = cut if cut > at else at + PART
        n, at = n + len(encode(text[at:cut])), cut
    return n + len(encode(text[at:] if at else text))


def with_tokens(df: DataFrame, keep: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """The columns keep of df and tokens (long): of each row's text. The text itself isn't passed on."""
    names = [f"k{i}" for i in range(len(keep))]
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep) + ", tokens long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = pa.array([count_tokens(t, path) for t in b.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*keep, "tokens"])

    return df.select(*(F.col(c).alias(n) for c, n in zip(keep, names)), F.col(text).alias("text")).mapInArrow(count, schema)
