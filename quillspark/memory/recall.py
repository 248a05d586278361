"""Hybrid search over memory entries, and their upkeep.

Entries have id, content, vector (array of floats or null), timestamp (seconds), importance (0..1), tags, associations
(ids), namespace, session, external_id, model, expires_at (seconds or null), revision, sha256.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import retrieval, vectors

SCHEMA = "id long, content string, vector array<float>, timestamp long, importance double, tags array<string>, associations array<long>, namespace string, session string, external_id string, model string, expires_at long, revision long, sha256 string"
#: Shares of a recall's score, of retention, and what an associated entry inherits.
RECALL = {"vector": 0.45, "words": 0.35, "recency": 0.10, "importance": 0.10}
RETENTION = {"importance": 0.6, "recency": 0.4}
ASSOCIATED = 0.85
#: Seconds in which recency falls by half.
HALF_LIFE = 30 * 86_400.0


@dataclass(frozen=True)
class Scope:
    """What may be seen: namespace in any case, session exactly; None doesn't restrict."""

    namespace: str | None = None
    session: str | None = None

    def of(self, df: DataFrame) -> DataFrame:
        if self.namespace is not None:
            df = df.where(F.lower("namespace") == self.namespace.lower())
        return df.where(F.col("session") == self.session) if self.session is not None else df


def recency(now: int, half_life: float) -> Column:
    """exp(-ln 2 * age / half life), 1 for entries of the future."""
    return F.exp(-math.log(2) * F.greatest(F.lit(0.0), F.lit(now) - F.col("timestamp")) / half_life)


def alive(df: DataFrame, now: int) -> DataFrame:
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def visible(df: DataFrame, scope: Scope, now: int, tags: list[str] | None = None, model: str | None = None) -> DataFrame:
    """Entries in scope that haven't expired, with any of the tags, of one model's vectors if named."""
    df = alive(scope.of(df), now)
    if tags:
        df = df.where(F.arrays_overlap(F.transform("tags", F.lower), F.array(*(F.lit(t.lower()) for t in tags))))
    return df.where(F.col("model") == model) if model is not None else df


def _cosine(query: list[float] | None) -> Column:
    if query is None:
        return F.lit(0.0)
    return F.greatest(F.lit(0.0), 1 - vectors.cosine_distance("vector", F.array(*(F.lit(float(x)) for x in query))))


def recall(df: DataFrame, text: str = "", vector: list[float] | None = None, now: int = 0, k: int = 10, half_life: float = HALF_LIFE, scope: Scope = Scope(), tags: list[str] | None = None, hops: int = 0, min_score: float = 0.0) -> DataFrame:
    """id, score: entries that match the words or the vector and score min_score or more, by weighted parts; ties by id.

    With hops, entries that matched neither but are associated with the k best join them at 0.85 of the best of those scores.
    """
    seen = visible(df, scope, now, tags)
    words = retrieval.bm25(seen, "id", "content", text).select("id", F.col("norm").alias("w")) if text else None
    rows = seen.select("id", "associations", _cosine(vector).alias("v"), recency(now, half_life).alias("r"), F.coalesce("importance", F.lit(0.0)).alias("i"))
    rows = rows.join(words, "id", "left") if words is not None else rows.withColumn("w", F.lit(0.0))
    rows = rows.withColumn("w", F.coalesce("w", F.lit(0.0)))
    if text or vector is not None:
        rows = rows.where("w > 0 or v > 0")
    score = RECALL["vector"] * F.col("v") + RECALL["words"] * F.col("w") + RECALL["recency"] * F.col("r") + RECALL["importance"] * F.col("i")
    rows = rows.select("id", "associations", score.alias("score"))
    top = rows.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(k)
    if not hops:
        return top.select("id", "score")
    near = top.select(F.explode("associations").alias("id"), (F.col("score") * ASSOCIATED).alias("score")).groupBy("id").agg(F.max("score").alias("score"))
    near = near.join(seen.select("id"), "id", "left_semi").join(rows.select("id"), "id", "left_anti").where(F.col("score") >= min_score)
    return top.select("id", "score").unionByName(near).orderBy(F.desc("score"), "id").limit(k)


def recall_fused(df: DataFrame, text: str, vector: list[float], now: int = 0, k: int = 10, candidates: int = 128, rrf_k: int = 60, scope: Scope = Scope(), weights: tuple[float, float] = (1.0, 1.0), model: str | None = None) -> DataFrame:
    """id, score: the words' and the vector's best candidates, fused by rank; vectors of other models never mix in."""
    seen = visible(df, scope, now)
    words = retrieval.bm25(seen, "id", "content", text, candidates).select("id", F.col("score").alias("x"))
    near = visible(df, scope, now, model=model).where("vector is not null").select("id", _cosine(vector).alias("x")).where("x > 0").orderBy(F.desc("x"), "id").limit(candidates)
    return retrieval.fuse([(words, "x", weights[0]), (near, "x", weights[1])], "id", rrf_k, k)


def search_indexed(df: DataFrame, text: str = "", vector: list[float] | None = None, now: int = 0, k: int = 10, candidates: int = 128, fusion: str = "rrf", rrf_k: int = 20, half_life: float = HALF_LIFE,
                   scope: Scope = Scope(), model: str | None = None, weights: tuple[float, float] = (1.0, 1.0), blend: tuple[float, float] = (0.1, 0.1), min_score: float = 0.0) -> DataFrame:
    """id, score within 0 and 1: the best candidates of words and vector, fused by rank (rrf) or by weighted scores (weighted), blended with recency and importance.

    Fused scores are brought to 0..1 by the best that there can be. Vectors of other models never mix in; ties by id.
    """
    seen = visible(df, scope, now)
    channels = []
    if text:
        channels.append((retrieval.bm25(seen, "id", "content", text, candidates).select("id", F.col("norm").alias("x")), weights[0]))
    if vector is not None:
        near = visible(df, scope, now, model=model).where("vector is not null").select("id", _cosine(vector).alias("x")).where("x > 0").orderBy(F.desc("x"), "id").limit(candidates)
        channels.append((near, weights[1]))
    if not channels:
        return seen.select("id", F.lit(0.0).alias("score")).limit(0)
    total = sum(w for _, w in channels)
    if fusion == "rrf":
        fused = retrieval.fuse([(c, "x", w) for c, w in channels], "id", rrf_k).select("id", (F.col("score") * (rrf_k + 1) / total).alias("f"))
    elif fusion == "weighted":
        parts = [c.select("id", (F.col("x") * w / total).alias("f")) for c, w in channels]
        fused = functools.reduce(DataFrame.unionAll, parts).groupBy("id").agg(F.sum("f").alias("f"))
    else:
        raise ValueError(f"unknown fusion: {fusion}")
    r, i = blend
    score = (1 - r - i) * F.col("f") + r * recency(now, half_life) + i * F.coalesce("importance", F.lit(0.0))
    out = seen.join(fused, "id").select("id", F.least(F.lit(1.0), F.greatest(F.lit(0.0), score)).alias("score"))
    return out.where(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(k)


class RevisionError(ValueError):
    """An entry's revision isn't the expected one, or its key exists or doesn't; nothing is stored."""


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumns({"_n": F.lower(F.coalesce("namespace", F.lit(""))), "_s": F.coalesce("session", F.lit(""))})


def store(current: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """All entries after new ones are stored; a known key is an error."""
    if not _keyed(new).where("external_id is not null").join(_keyed(current).select("_n", "_s", "external_id"), ["_n", "_s", "external_id"], "left_semi").isEmpty():
        raise RevisionError("an entry with this key exists")
    return upsert(current, new, now)


def compare_and_set(current: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """As upsert, but each new entry has expected_revision: that of the entry it replaces, 0 if there must be none, null for any."""
    old = _keyed(current).select("_n", "_s", "external_id", F.col("revision").alias("_revision"))
    met = _keyed(new).join(old, ["_n", "_s", "external_id"], "left")
    if not met.where("expected_revision is not null and expected_revision <> coalesce(_revision, 0)").isEmpty():
        raise RevisionError("a revision isn't the expected one")
    return upsert(current, new.drop("expected_revision"), now)


def purge(df: DataFrame, now: int) -> DataFrame:
    """Without expired entries, in associations too."""
    return forget_where(df, F.coalesce(F.col("expires_at") <= now, F.lit(False)))


def delete_scoped(df: DataFrame, scope: Scope) -> DataFrame:
    """Without the entries of a scope, in associations too; a scope that restricts nothing is an error."""
    if scope.namespace is None and scope.session is None:
        raise ValueError("a scope must name a namespace or a session")
    hit = F.lit(True)
    if scope.namespace is not None:
        hit &= F.lower("namespace") == scope.namespace.lower()
    if scope.session is not None:
        hit &= F.col("session") == scope.session
    return forget_where(df, F.coalesce(hit, F.lit(False)))


def forget_where(df: DataFrame, hit: Column) -> DataFrame:
    """Without the rows for which hit holds; associations with them go by a join, so they may be any number."""
    gone = df.where(hit).select(F.col("id").alias("_gone"))
    kept = df.where(~hit)
    links = kept.select("id", F.posexplode("associations").alias("_p", "_gone")).join(gone, "_gone", "left_anti").groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("_p", "_gone"))), lambda x: x["_gone"]).alias("_a"))
    none = F.array().cast("array<bigint>")
    return kept.join(links, "id", "left").withColumn("associations", F.when(F.col("associations").isNotNull(), F.coalesce("_a", none))).select(*df.columns)


def upsert(current: DataFrame, new: DataFrame, now: int) -> DataFrame:
    """All entries after the new ones are stored: key is (lower-case namespace, session, external_id); a known one keeps its id, time and associations, and its revision grows.

    Entries without external_id are always new. Of several new ones with one key the last by content hash is stored.
    """
    key = lambda df: df.withColumns({"_n": F.lower(F.coalesce("namespace", F.lit(""))), "_s": F.coalesce("session", F.lit(""))})
    new = new.withColumns({"sha256": F.sha2(F.col("content"), 256), "timestamp": F.lit(now).cast("long"), "revision": F.lit(1).cast("long")})
    loose, keyed = key(new).where("external_id is null"), key(new).where("external_id is not null")
    keyed = keyed.groupBy("_n", "_s", "external_id").agg(F.max_by(F.struct(*new.columns), "sha256").alias("_r")).select("_n", "_s", "_r.*")
    old = key(current).select("_n", "_s", "external_id", F.struct("id", "timestamp", "associations", "revision").alias("_o"))
    met = keyed.join(old, ["_n", "_s", "external_id"], "left")
    known = F.col("_o").isNotNull()
    put = {"id": F.when(known, F.col("_o.id")).otherwise(F.col("id")), "timestamp": F.when(known, F.col("_o.timestamp")).otherwise(F.col("timestamp")), "associations": F.when(known, F.col("_o.associations")).otherwise(F.col("associations")), "revision": F.when(known, F.col("_o.revision") + 1).otherwise(F.col("revision"))}
    stored = met.withColumns(put).select(*current.columns)
    rest = key(current).join(keyed.select("_n", "_s", "external_id"), ["_n", "_s", "external_id"], "left_anti").select(*current.columns)
    return rest.unionByName(stored).unionByName(loose.select(*current.columns))


def retention(now: int, half_life: float) -> Column:
    return RETENTION["importance"] * F.coalesce("importance", F.lit(0.0)) + RETENTION["recency"] * recency(now, half_life)


def prune(df: DataFrame, now: int, least: float, half_life: float = HALF_LIFE) -> DataFrame:
    """Entries that haven't expired and whose retention is least or more."""
    return alive(df, now).where(retention(now, half_life) >= least)


def forget(df: DataFrame, ids: list[int]) -> DataFrame:
    """Without the ids, in associations too."""
    gone = F.array(*(F.lit(i).cast("long") for i in ids)) if ids else F.array().cast("array<bigint>")
    return df.where(~F.array_contains(gone, F.col("id"))).withColumn("associations", F.array_except("associations", gone))


def associate(df: DataFrame, a: int, b: int) -> DataFrame:
    """a and b associated with each other, once."""
    add = lambda x, y: F.when(F.col("id") == x, F.array_union(F.coalesce("associations", F.array().cast("array<bigint>")), F.array(F.lit(y).cast("long"))))
    return df.withColumn("associations", F.coalesce(add(a, b), add(b, a), F.col("associations")))
