"""Decisions about texts by their words: choose a label, score against criteria, verify a statement, choose a route.

They are SQL expressions over word arrays, so they stay in the JVM. The dense part of a score is the cosine of the two
texts' sets of words. Lists of words that speak for a label are a parameter, and empty by default.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import retrieval

# Weights of the parts of each score, its steepness, and the words that turn a statement around or carry no order.
CLASSIFY = {"dense": 0.2, "overlap": 1.2, "associated": 0.8, "temperature": 0.7}
SCORE = {"dense": 0.4, "share": 1.2, "steep": 3.5}
VERIFY = {"dense": 0.4, "dense_from": 0.3, "overlap": 1.2, "overlap_from": 0.15, "overlap_least": 0.18, "no_overlap": -0.4, "turned": -1.6, "order": -2.0, "steep": 3.2, "threshold": 0.5}
GROUNDED = {"verify": (0.6, 0.4), "classify": (0.65, 0.35)}
NEGATIONS = "not never untrue neither nor wont dont isnt arent didnt tidak bukan tak takde jangan nunca jamas jamais nicht kein keine".split()
STOPWORDS = "the a an is are was were to of in on at by for with about".split()

FUNCTIONS = (
    ("quill_word_list", "s STRING", r"filter(split(lower(s), '[\\s\\p{Punct}]+'), x -> x <> '')"),
    ("quill_words", "s STRING", "array_distinct(quill_word_list(s))"),
    ("quill_dense", "a ARRAY<STRING>, b ARRAY<STRING>", "CASE WHEN size(a) > 0 AND size(b) > 0 THEN size(array_intersect(a, b)) / sqrt(CAST(size(a) AS DOUBLE) * size(b)) ELSE 0D END"),
    ("quill_overlap", "a ARRAY<STRING>, b ARRAY<STRING>", """
        CASE WHEN size(a) > 0 AND size(b) > 0 THEN least(1D, aggregate(a, 0D, (s, x) -> s + aggregate(b, 0D, (t, y) -> t + CASE WHEN x = y THEN 1D
        WHEN octet_length(x) >= 4 AND octet_length(y) >= 4 AND (startswith(x, y) OR startswith(y, x)) THEN 0.7D ELSE 0D END)) / least(size(a), size(b))) ELSE 0D END"""),
    ("quill_bigrams", "s STRING", f"transform(sequence(1, size(filter(quill_word_list(s), x -> NOT array_contains(array({', '.join(repr(w) for w in STOPWORDS)}), x))) - 1), i -> concat_ws(' ', slice(filter(quill_word_list(s), x -> NOT array_contains(array({', '.join(repr(w) for w in STOPWORDS)}), x)), i, 2)))"),
    ("quill_ordered", "s STRING", f"filter(quill_word_list(s), x -> NOT array_contains(array({', '.join(repr(w) for w in STOPWORDS)}), x))"),
    ("quill_same_order", "a STRING, b STRING", "CASE WHEN size(quill_ordered(a)) < 2 OR size(quill_ordered(b)) < 2 THEN 1D ELSE size(array_intersect(quill_bigrams(a), quill_bigrams(b))) / least(size(array_distinct(quill_bigrams(a))), size(array_distinct(quill_bigrams(b)))) END"),
    ("quill_sigmoid", "x DOUBLE", "1 / (1 + exp(-x))"),
    ("quill_score", "s STRING, c STRING", f"quill_sigmoid({SCORE['steep']}D * ({SCORE['dense']}D * quill_dense(quill_words(s), quill_words(c)) + {SCORE['share']}D * CASE WHEN size(quill_words(c)) > 0 THEN size(array_intersect(quill_words(s), quill_words(c))) / size(quill_words(c)) ELSE 0D END))"),
    ("quill_turned", "s STRING", f"arrays_overlap(quill_words(s), array({', '.join(repr(w) for w in NEGATIONS)}))"),
    ("quill_confidence", "p STRING, h STRING", f"""
        quill_sigmoid({VERIFY['steep']}D * ({VERIFY['dense']}D * (quill_dense(quill_words(p), quill_words(h)) - {VERIFY['dense_from']}D)
        + CASE WHEN quill_turned(p) <> quill_turned(h) THEN {VERIFY['turned']}D WHEN quill_overlap(quill_words(p), quill_words(h)) > {VERIFY['overlap_least']}D THEN {VERIFY['overlap']}D * (quill_overlap(quill_words(p), quill_words(h)) - {VERIFY['overlap_from']}D) ELSE {VERIFY['no_overlap']}D END
        + CASE WHEN quill_overlap(quill_words(p), quill_words(h)) > 0.8D AND quill_same_order(p, h) < 0.4D AND size(quill_words(p)) >= 4 AND size(quill_words(h)) >= 4 THEN {VERIFY['order']}D ELSE 0D END))"""),
)


def register(spark: SparkSession) -> None:
    for name, params, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({params}) RETURN {body}")


def labels_of(text: str) -> list[str]:
    """The labels of a comma list, each once, in order."""
    out = list(dict.fromkeys(x.strip() for x in text.split(",") if x.strip()))
    if not out:
        raise ValueError("at least one label is needed")
    return out


def _quoted(x: str) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "''") + "'"


def classify_sql(text: str, labels: list[str], associations: dict[str, list[str]] | None = None) -> tuple[str, str]:
    """SQL of the likeliest label (the first of equals) and of the array of the labels' logits, for the SQL of a text."""
    logits = []
    for x in labels:
        words = f"quill_words({_quoted(x)})"
        bonus = "".join(f" + CASE WHEN array_contains(quill_words({text}), {_quoted(w)}) THEN {CLASSIFY['associated']}D ELSE 0D END" for w in (associations or {}).get(x.lower(), ()))
        logits.append(f"{CLASSIFY['dense']}D * quill_dense(quill_words({text}), {words}) + {CLASSIFY['overlap']}D * quill_overlap(quill_words({text}), {words}){bonus}")
    scores = f"array({', '.join(logits)})"
    return f"element_at(array({', '.join(map(_quoted, labels))}), CAST(array_position({scores}, array_max({scores})) AS INT))", scores


def calls(prefix: str = "text_", associations: dict[str, list[str]] | None = None) -> dict:
    """SQL calls by name: <prefix>classify(text, 'a, b'), score(text, criteria), verify(premise, hypothesis[, threshold]), route(text, 'a, b')."""
    choose = lambda a: classify_sql(a[0], labels_of(a[1].strip("'").replace("''", "'")), associations)[0]
    return {
        f"{prefix}classify": choose, f"{prefix}route": choose, f"{prefix}score": lambda a: f"quill_score({a[0]}, {a[1]})",
        f"{prefix}verify": lambda a: f"CAST(quill_confidence({a[0]}, {a[1]}) >= {a[2] if len(a) > 2 else VERIFY['threshold']} AS INT)",
    }


def classify(df: DataFrame, text: str, labels: list[str], associations: dict[str, list[str]] | None = None) -> DataFrame:
    """df with label, confidence (softmax at the temperature) and entropy of the label; a null text has no words."""
    register(df.sparkSession)
    top, scores = classify_sql(f"coalesce(`{text}`, '')", labels, associations)
    p = F.transform("_e", lambda x: x / F.aggregate("_e", F.lit(0.0), lambda a, y: a + y))
    out = df.withColumn("label", F.expr(top)).withColumn("_e", F.transform(F.expr(scores), lambda x: F.exp(x / CLASSIFY["temperature"]))).withColumn("_p", p)
    return out.withColumn("confidence", F.array_max("_p")).withColumn("entropy", F.aggregate("_p", F.lit(0.0), lambda a, x: a - F.when(x > 1e-9, x * F.log(x)).otherwise(0.0))).drop("_e", "_p")


#: Most texts of a grounding index, which every task holds.
MOST_GROUND = 200_000


def ground(df: DataFrame, text: str, index: DataFrame, indexed: str, k: int = 3, dims: int = 128) -> DataFrame:
    """df with grounding: the mean similarity (0..1) of a text to its k nearest of a bounded index of texts; .5 for an empty index.

    Similarities are those of hash embeddings. The index goes to every task, so one of over ``MOST_GROUND`` is refused.
    """
    rows = retrieval.embed(index.select(indexed), indexed, "v", dims).select("v").limit(MOST_GROUND + 1).toPandas()
    if len(rows) > MOST_GROUND:
        raise ValueError(f"a grounding index takes at most {MOST_GROUND} texts")
    table = np.stack(rows["v"].to_numpy()).astype("f4") if len(rows) else np.zeros((0, dims), "f4")

    @F.pandas_udf("double")
    def near(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            if not len(table):
                yield pd.Series(np.full(len(s), 0.5))
                continue
            q = np.stack([retrieval.embed_text(t, dims) for t in s])
            sims = (1 + np.clip(q @ table.T, -1, 1)) / 2
            top = np.sort(sims, axis=1)[:, -max(1, k) :]
            yield pd.Series(top.mean(1).astype("f8"))

    return df.withColumn("grounding", near(F.col(text)))


def grounded(kind: str, confidence: Column, grounding: Column) -> Column:
    """A confidence of classify or verify blended with the grounding, within 0 and 1."""
    a, b = GROUNDED[kind]
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), a * confidence + b * grounding))
