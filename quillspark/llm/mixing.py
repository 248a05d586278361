"""Problem 9: sources are mixed to target shares of the tokens, each document used at most a capped number of times.

The tokens are summed by source and hash bucket. A source whose budget is q times its tokens plus a rest uses every
document q times, and once more those whose hash lies under the threshold at which the rest is used up. The threshold
is found level by level: the histogram over 1,024 buckets of the hash gives the boundary bucket, and only that one is
split again by the next ten bits. Only histograms, of at most 1,024 rows a source and level, reach the driver; the
documents are filtered by their hash and never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.tokens import VOCABULARY, with_tokens
from quillspark.session import checkpointed

BITS, LEVELS = 10, 6


def _targets(targets: DataFrame) -> DataFrame:
    return (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0))).cast("long").alias("max_repeats"))
    )


def source_budgets(tokens: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of targets: target_share, max_repeats, documents, available, budget, short.

    tokens has source, doc_id and tokens, of the listed sources only. budget is the source's share of all their tokens,
    each document counted once; a source is short if its tokens times max_repeats are less. A listed source without
    documents is there with 0; of a source listed twice the larger share and cap count; a null share is 0.
    """
    have = tokens.groupBy("source").agg(F.sum("tokens").alias("available"), F.count(F.lit(1)).alias("documents"))
    total = have.agg(F.coalesce(F.sum("available"), F.lit(0)).alias("total"))
    zero = F.lit(0).cast("long")
    return (
        _targets(targets).join(have, "source", "left").crossJoin(F.broadcast(total))  # total is one row
        .select("source", "target_share", "max_repeats", F.coalesce("documents", zero).alias("documents"), F.coalesce("available", zero).alias("available"), (F.col("target_share") * F.col("total")).alias("budget"))
        .withColumn("short", F.col("available") * F.col("max_repeats") < F.col("budget"))
    )


def listed_tokens(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """source, doc_id, tokens of the documents whose source is listed. A null source is in no list."""
    listed = _targets(targets).select("source")
    return with_tokens(documents.select("source", "doc_id", "text").join(listed, "source", "left_semi"), ["source", "doc_id"], "text", path)


def _slot(level: int) -> Column:
    return F.shiftright(F.col("h"), 60 - BITS * (level + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def mixture_plan(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> tuple[DataFrame, dict[str, list]]:
    """The tokens of the listed documents with their hash h, and the plan.

    The plan has by source: times all its documents are used, tokens still to use, the hash below which documents are
    used once more, and whether the source is short. The histogram of the first level tells the budgets, too.
    """
    spark = documents.sparkSession
    tokens = checkpointed(listed_tokens(documents, targets, path)).withColumn("h", F.xxhash64("source", "doc_id").bitwiseAND(F.lit((1 << 60) - 1)))
    first = checkpointed(tokens.groupBy("source", _slot(0).alias("slot")).agg(F.sum("tokens").alias("tokens")))
    plan: dict[str, list] = {}
    for r in source_budgets(first, targets).collect():  # one row a listed source
        whole = min(int(r.budget // r.available) if r.available else 0, r.max_repeats)
        rest = r.budget - whole * r.available if whole < r.max_repeats else 0.0
        plan[r.source] = [whole, rest, 0, r.short]
    open_ = {s: 0 for s, p in plan.items() if p[1] > 0}  # source: prefix of its boundary bucket
    for level in range(LEVELS):
        if not open_:
            break
        bounds = spark.createDataFrame([(s, int(x)) for s, x in open_.items()], "source string, prefix long")
        if level:
            inside = tokens.join(F.broadcast(bounds), "source").where(F.shiftright("h", 60 - BITS * level) == F.col("prefix"))  # bounds: one row a source
            counts = inside.groupBy("source", _slot(level).alias("slot")).agg(F.sum("tokens").alias("t"))
        else:
            counts = first.join(F.broadcast(bounds), "source").select("source", "slot", F.col("tokens").alias("t"))
        rows: dict[str, list] = {}
        for r in counts.collect():  # at most 1,024 rows a source
            rows.setdefault(r.source, []).append((r.slot, r.t))
        step = 60 - BITS * (level + 1)
        for s in list(open_):
            prefix, boundary = open_.pop(s), None
            for slot, t in sorted(rows.get(s, [])):
                if t > plan[s][1]:
                    boundary = (prefix << BITS) + slot
                    break
                plan[s][1] -= t
            if boundary is None:
                plan[s][2] = (prefix + 1) << (60 - BITS * level)
            else:
                plan[s][2] = boundary << step
                open_[s] = boundary
    return tokens, plan


def short_sources(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """source of each short source of the mixture, from its plan."""
    plan = mixture_plan(documents, targets, path)[1]
    return documents.sparkSession.createDataFrame([(s,) for s, p in plan.items() if p[3]], "source string")


def mix(documents: DataFrame, targets: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row per document used: source, doc_id, tokens, repeats (1 to the source's max_repeats).

    Each source's tokens times repeats are as near its budget from below as one document allows, or all it has if it is
    short. An empty text is used like its bucket. Equal doc_ids are used alike.
    """
    spark = documents.sparkSession
    tokens, plan = mixture_plan(documents, targets, path)
    chosen = spark.createDataFrame([(s, p[0], int(p[2])) for s, p in plan.items()] or [("", 0, 0)], "source string, whole long, below long")
    used = F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)
    return tokens.join(F.broadcast(chosen), "source").select("source", "doc_id", "tokens", used.alias("repeats")).where("repeats > 0")


def actual_shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, used_tokens, actual_share of a mixture; a source of which nothing is used has 0."""
    used = mixed.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"))
    total = used.agg(F.sum("used_tokens").alias("total"))
    zero = F.lit(0).cast("long")
    return (
        _targets(targets).join(used, "source", "left").crossJoin(F.broadcast(total))  # total is one row
        .select("source", "target_share", F.coalesce("used_tokens", zero).alias("used_tokens"), F.coalesce(F.col("used_tokens") / F.col("total"), F.lit(0.0)).alias("actual_share"))
    )
