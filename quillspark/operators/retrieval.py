"""Text retrieval: BM25, rank fusion, and embeddings by hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.lite import tokens_of

K1, B, LEAST_IDF, RRF_K = 1.2, 0.75, 0.1, 60


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf, dl: how often each term stands in each document, and the document's length in tokens."""
    return df.select(key, tokens_of(text).alias("t")).select(key, F.size("t").alias("dl"), F.explode("t").alias("term")).groupBy(key, "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(df: DataFrame, key: str, text: str, query: str, k: int | None = None, where: Column | str | None = None, least_idf: float = LEAST_IDF, repeats: bool = False) -> DataFrame:
    """key, score, norm (score over the greatest): documents with a term of the query, best first, ties by key.

    Document counts and mean length are those of all documents, and where filters before scoring. Only the query's
    terms are exploded, so the shuffle holds matches, not the collection's words. A query without tokens gives no rows.
    repeats: a term counts as often as the query has it.
    """
    terms = sorted(set(_tokens(query)))
    listed = F.array(*(F.lit(t) for t in terms)) if terms else F.array().cast("array<string>")
    docs = df.select(key, *( [F.expr(where).alias("_in")] if isinstance(where, str) else [where.alias("_in")] if where is not None else [F.lit(True).alias("_in")]), tokens_of(text).alias("t"))
    lengths = docs.agg(F.count(F.lit(1)).alias("n"), F.greatest(F.avg(F.coalesce(F.size("t"), F.lit(0))), F.lit(1.0)).alias("avgdl"))
    hits = docs.select(key, "_in", F.size("t").alias("dl"), F.filter("t", lambda x: F.array_contains(listed, x)).alias("t")).where(F.size("t") > 0)
    tf = hits.select(key, "_in", "dl", F.explode("t").alias("term")).groupBy(key, "_in", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))
    df_ = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))  # one row a term of the query
    n, d = F.col("n"), F.col("df")
    idf = F.greatest(F.lit(least_idf), F.log(1 + (n - d + 0.5) / (d + 0.5)))
    if repeats and terms:
        idf = idf * F.element_at(F.create_map(*(x for t in terms for x in (F.lit(t), F.lit(_tokens(query).count(t))))), F.col("term"))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.where("_in").join(F.broadcast(df_), "term").crossJoin(F.broadcast(lengths)).groupBy(key).agg(F.sum(part).alias("score"))
    if k is not None:
        scored = scored.orderBy(F.desc("score"), key).limit(k)
    top = scored.agg(F.max("score").alias("_most"))
    return scored.crossJoin(F.broadcast(top)).select(key, "score", (F.col("score") / F.col("_most")).alias("norm")).orderBy(F.desc("score"), key)


def _tokens(text: str) -> list[str]:
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{N}_-]+", text.lower()) if len(t.encode()) > 1]


def fuse(lists: list[tuple[DataFrame, str, float]], key: str, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """key, score: the sum of weight / (k + rank) over ranked lists of (table, column to order by descending, weight); ties by key.

    Each list should be a top-k already, since its ranks are numbered in one window.
    """
    parts = None
    for df, order, weight in lists:
        rank = F.row_number().over(Window.orderBy(F.desc(order), F.col(key)))
        one = df.select(key, (F.lit(float(weight)) / (k + rank)).alias("part"))
        parts = one if parts is None else parts.unionAll(one)
    out = parts.groupBy(key).agg(F.sum("part").alias("score")).orderBy(F.desc("score"), key)
    return out.limit(limit) if limit is not None else out


# Fixed values of the hash embedding: seed and weight by kind of n-gram, words used for character n-grams, decay by position.
SEEDS = {"word1": 0x9747B28C, "word2": 0x5BD1E995, "word3": 0x27D4EB2F, "char3": 0x12B9B0A1, "char4": 0x3C6EF372}
GRAM_WEIGHTS = {"word1": 1.5, "word2": 2.0, "word3": 2.5, "char3": 0.8, "char4": 1.0}
CHAR_WORDS, DECAY = 30, 0.05


def _mix(grams: list[bytes], seed: int) -> np.ndarray:
    """32-bit hash of each gram, all grams a byte at a time."""
    size = max(map(len, grams))
    table = np.zeros((len(grams), size), "u4")
    lengths = np.array([len(g) for g in grams])
    flat = np.frombuffer(b"".join(grams), "u1")
    table[np.arange(size) < lengths[:, None]] = flat
    h = np.full(len(grams), seed, "u4")
    for j in range(size):
        x = h * np.uint32(31) + table[:, j]
        x = (x << np.uint32(13)) | (x >> np.uint32(19))
        x ^= x >> np.uint32(15)
        h = np.where(j < lengths, x, h)
    return h


def embed_text(text: str | None, dims: int = 128) -> np.ndarray:
    """Unit vector of a text from hashed word and character n-grams; the zero vector if it has no letter or digit."""
    import regex

    dims = max(16, dims)
    words = regex.findall(r"[\p{Alphabetic}\p{N}]+", (text or "").lower())
    out = np.zeros(dims, "f4")
    if not words:
        return out
    grams: dict[str, list[str]] = {"word1": words, "word2": ["_".join(x) for x in zip(words, words[1:])], "word3": ["_".join(x) for x in zip(words, words[1:], words[2:])]}
    for n in (3, 4):
        grams[f"char{n}"] = [w[i : i + n] for w in words[:CHAR_WORDS] for i in range(len(w) - n + 1)]
    for kind, own in grams.items():
        if own:
            h = _mix([g.encode() for g in own], SEEDS[kind])
            weight = np.full(len(own), GRAM_WEIGHTS[kind], "f4")
            if kind == "word1":
                weight /= 1 + np.arange(len(own), dtype="f4") * np.float32(DECAY)
            np.add.at(out, h % dims, np.where(h & 1, -weight, weight))
    length = np.sqrt((out * out).sum())
    return out / length if length > 1e-9 else out


def embed(df: DataFrame, text: str, name: str = "embedding", dims: int = 128) -> DataFrame:
    """df with the hash embedding of a text column."""

    @F.pandas_udf("array<float>")
    def apply(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([embed_text(t, dims) for t in s])

    return df.withColumn(name, apply(F.col(text)))
