"""The queries of the training-data problems over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: The similarity that the test data's statement of problem 4 names.
P4_SIMILARITY = 0.75


def _query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@_query
def p1_found(spark, sf_dir):
    from quillspark.llm.scans import repaired

    return repaired(_read(spark, sf_dir, "pdf_text")).select("chunk_id", F.explode("defects").alias("defect")).distinct()


@_query
def p1_repaired(spark, sf_dir):
    from quillspark.llm.scans import repaired

    return repaired(_read(spark, sf_dir, "pdf_text")).select("chunk_id", "content")


@_query
def p2_found(spark, sf_dir):
    from quillspark.llm.chunking import split_oversized

    return split_oversized(_read(spark, sf_dir, "pdf_text")).where("piece_count > 1 and piece_index = 0").select("chunk_id")


@_query
def p2_pieces(spark, sf_dir):
    from quillspark.llm.chunking import split_oversized

    return split_oversized(_read(spark, sf_dir, "pdf_text"))


@_query
def p3_found(spark, sf_dir):
    from quillspark.llm.neighbours import nearest_neighbours, neighbour_pairs

    return neighbour_pairs(nearest_neighbours(_read(spark, sf_dir, "langchain_vectors")))


@_query
def p3_neighbours(spark, sf_dir):
    from quillspark.llm.neighbours import nearest_neighbours

    return nearest_neighbours(_read(spark, sf_dir, "langchain_vectors")).withColumn("score", F.round("score", 4))


@_query
def p4_found(spark, sf_dir):
    from quillspark.llm.nearcopies import all_pairs, near_copies

    pairs = all_pairs(*near_copies(_read(spark, sf_dir, "device_memory"), "mem_id", "content", P4_SIMILARITY))
    return pairs.select(F.col("a").alias("mem_id_a"), F.col("b").alias("mem_id_b"))


@_query
def p4_groups(spark, sf_dir):
    from quillspark.llm.nearcopies import copy_groups, near_copies

    return copy_groups(*near_copies(_read(spark, sf_dir, "device_memory"), "mem_id", "content", P4_SIMILARITY)).withColumnRenamed("k", "mem_id")


def _labelled(spark, sf_dir):
    from quillspark.llm.languages import labelled_records

    return labelled_records({"device_memory": (_read(spark, sf_dir, "device_memory"), "mem_id"), "tap_knowledge_base": (_read(spark, sf_dir, "tap_knowledge_base"), "id")})


@_query
def p5_found(spark, sf_dir):
    from quillspark.llm.languages import label_cases, segments

    return label_cases(segments(_labelled(spark, sf_dir)))


@_query
def p5_segments(spark, sf_dir):
    from quillspark.llm.languages import segments

    return segments(_labelled(spark, sf_dir)).withColumn("confidence", F.round("confidence", 4)).distinct()


@_query
def p6_found(spark, sf_dir):
    from quillspark.llm.pairs import find_defects

    return find_defects(_read(spark, sf_dir, "tap_chat_logs"))


@_query
def p7_found(spark, sf_dir):
    from quillspark.llm.conversations import session_states

    return session_states(_read(spark, sf_dir, "tapirus_chat_history")).where("not keep").select("session_id")


@_query
def p7_conversations(spark, sf_dir):
    from quillspark.llm.conversations import conversations

    return conversations(_read(spark, sf_dir, "tapirus_chat_history"))


@_query
def p7_links(spark, sf_dir):
    from quillspark.llm.conversations import exchanges, message_rows, reply_links

    return reply_links(exchanges(message_rows(_read(spark, sf_dir, "tapirus_chat_history")))).withColumn("score", F.round("score", 4))


@_query
def p8_found(spark, sf_dir):
    from quillspark.llm.packing import pack_documents

    return pack_documents(_read(spark, sf_dir, "documents")).where("piece_count > 1 and piece_index = 0").select("doc_id")


@_query
def p8_containers(spark, sf_dir):
    from quillspark.llm.packing import containers, pack_documents

    return containers(pack_documents(_read(spark, sf_dir, "documents")))


@_query
def p8_bounded(spark, sf_dir):
    from quillspark.llm.packing import BOUNDED, containers, pack_documents

    return containers(pack_documents(_read(spark, sf_dir, "documents"), **BOUNDED))


@_query
def p9_found(spark, sf_dir):
    from quillspark.llm.mixing import short_sources

    return short_sources(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))


@_query
def p9_mix(spark, sf_dir):
    from quillspark.llm.mixing import mix

    return mix(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "mix_targets"))


@_query
def p9_shares(spark, sf_dir):
    from quillspark.llm.mixing import actual_shares, mix

    targets = _read(spark, sf_dir, "mix_targets")
    return actual_shares(mix(_read(spark, sf_dir, "documents"), targets), targets)


@_query
def p10_found(spark, sf_dir):
    from quillspark.llm.stuffing import stuffed_pages

    return stuffed_pages(_read(spark, sf_dir, "documents"))


@_query
def p10_scores(spark, sf_dir):
    from quillspark.llm.stuffing import page_scores

    return page_scores(_read(spark, sf_dir, "documents")).select("doc_id", *(F.round(c, 4).alias(c) for c in ("density", "link_share", "replicated")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


_SQL = {
    "p4_found": r"""
        WITH m AS (SELECT DISTINCT mem_id, list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM device_memory)
        SELECT a.mem_id AS mem_id_a, b.mem_id AS mem_id_b FROM m a JOIN m b
        ON a.mem_id < b.mem_id AND len(a.w) > 0 AND 4 * len(list_intersect(a.w, b.w)) >= 3 * len(list_distinct(list_concat(a.w, b.w)))""",
    "p2_found": "SELECT chunk_id FROM pdf_text WHERE length(content) > 1200",
    "p7_found": r"""
        WITH m AS (
            SELECT session_id, role, content, created_at, min(id) AS id
            FROM tapirus_chat_history
            WHERE trim(coalesce(session_id, '')) <> ''
            GROUP BY session_id, role, content, created_at
        ), k AS (
            SELECT session_id, id, CASE WHEN created_at < 100000000000 THEN created_at * 1000 ELSE created_at END AS ts,
                CASE WHEN lower(trim(role)) IN ('human', 'user') THEN 'q' WHEN lower(trim(role)) IN ('ai', 'assistant', 'bot') THEN 'r'
                     WHEN lower(trim(role)) = 'system' THEN 's' END AS kind,
                created_at IS NULL OR regexp_replace(coalesce(content, ''), '[\s\p{Z}\p{C}]+', '', 'g') = '' AS bad
            FROM m
        ), t AS (
            SELECT session_id, kind, lag(kind) OVER w AS before, lead(kind) OVER w AS after
            FROM k WHERE kind IN ('q', 'r') WINDOW w AS (PARTITION BY session_id ORDER BY ts NULLS FIRST, id)
        ), s AS (
            SELECT session_id, count(*) FILTER (kind = 'q') AS questions,
                count(*) FILTER ((kind = 'q' AND after IS DISTINCT FROM 'r') OR (kind = 'r' AND before IS DISTINCT FROM 'q')) AS broken
            FROM t GROUP BY session_id
        ), b AS (SELECT session_id, count(*) FILTER (bad OR kind IS NULL) AS bad FROM k GROUP BY session_id)
        SELECT session_id FROM b LEFT JOIN s USING (session_id)
        WHERE coalesce(questions, 0) = 0 OR bad > 0 OR broken > 0""",
}


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
