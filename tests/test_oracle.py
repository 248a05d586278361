"""Queries of the core against their SQL in DuckDB, on the smallest tables."""

import os

import pytest

from quillspark.plans import catalogue

SMALL = "/root/testdata/sf0.001"
CHECKED = (
    "grouped_stats", "statistics_per_group", "first_per_group", "filter_like", "not_in_null_list", "join_full", "join_null_keys", "star_join", "not_in_subquery_null", "compound_left_deep", "recursive_union_cycle",
    "win_ntile_compat", "win_full_partition_agg", "fn_strings", "fn_math", "fn_cast", "fn_dates", "fn_json", "match_any", "knn_cosine", "knn_filtered", "sq8_roundtrip", "bm25_topk", "rrf_fusion", "graph_match",
    "graph_bfs_depth", "graph_triangles", "cypher_count", "lww_merge", "window_tumbling", "memory_prune",
    "insert_returning", "insert_ignore", "insert_replace", "insert_upsert_where", "update_returning", "rollback_savepoint", "rollback_history", "cascade_delete", "delete_set_null", "update_cascade", "unique_violation",
    "alter_columns", "pragma_table_info", "sql_dates", "sql_casts", "sql_json", "sql_strings", "sql_vectors", "sql_match", "explain_plan", "fts_match_rank", "collection_find", "collection_changes", "text_classify", "text_score",
    "text_verify", "lake_hive_partitions", "lake_deep_glob", "csv_quoted_lines", "dump_copy", "copy_to_and_from", "read_in_statement", "graph_subgraph", "graph_has_edges", "graph_rag_filtered", "memory_recall_words",
    "memory_search_indexed", "memory_purge", "memory_compare_and_set", "metadata_count",
)


def norm(v):
    return "null" if v is None else f"{v:.5g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("the test tables aren't here")
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SMALL}/{f}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SMALL)
    r = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(norm(x[names.index(c)]) for c in sorted(names)) for x in r.fetchall())
    assert sorted(tuple(norm(x[c]) for c in sorted(names)) for x in df.collect()) == want
