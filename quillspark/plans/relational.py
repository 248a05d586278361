"""Scans, filters, joins, aggregates, windows, sorts, set operations and subqueries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import aggregates, recursion, setops, windows
from quillspark.plans.registry import Registry, read

add = Registry()
QUERIES, SQL = add.queries, add.sql
sql = add.spark_sql

sql(
    "grouped_stats",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS cnt, count(DISTINCT l_suppkey) AS suppliers, round(sum(l_quantity), 2) AS sum_qty,
        round(avg(l_extendedprice), 4) AS avg_price, min(l_discount) AS min_discount, max(l_tax) AS max_tax,
        round(stddev_samp(l_quantity), 6) AS sd_qty, round(var_pop(l_quantity), 6) AS vp_qty, round(median(l_quantity), 4) AS median_qty
    FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
    GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
    "lineitem",
)


@add("""
    SELECT l_linestatus, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(stddev_samp(l_tax), 6) AS tax_sd, round(stddev_pop(l_tax), 6) AS tax_sd_pop, round(var_samp(l_tax), 6) AS tax_var,
        round(median(l_quantity), 4) AS qty_median, round(quantile_cont(l_quantity, 0.9), 4) AS qty_p90
    FROM lineitem GROUP BY l_linestatus""")
def statistics_per_group(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    return li.groupBy("l_linestatus").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("l_partkey").alias("parts"), F.round(aggregates.stddev("l_tax"), 6).alias("tax_sd"),
        F.round(F.stddev_pop("l_tax"), 6).alias("tax_sd_pop"), F.round(F.var_samp("l_tax"), 6).alias("tax_var"),
        F.round(F.median("l_quantity"), 4).alias("qty_median"), F.round(aggregates.percentile("l_quantity", 0.9), 4).alias("qty_p90"),
    )


sql("global_agg_empty", "SELECT count(*) AS n, sum(o_totalprice) AS s, avg(o_totalprice) AS a, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM {orders} WHERE o_orderkey < 0", "orders")
sql("having_filter", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) >= 15 AND sum(o_totalprice) > 100000", "orders")
sql("count_kinds", "SELECT count(*) AS all_rows, count(1) AS ones, count(category) AS with_category, count(DISTINCT category) AS categories FROM {tap_knowledge_base}", "tap_knowledge_base")


@add("SELECT count(*) AS n FROM lineitem")
def metadata_count(spark, sf_dir):
    """From the footers only: the file source of a session of its own takes the count over."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return read(own, sf_dir, "lineitem").agg(F.count(F.lit(1)).alias("n"))


@add("SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS first_order, arg_min(o_orderstatus, o_orderkey) AS first_status FROM orders GROUP BY o_custkey")
def first_per_group(spark, sf_dir):
    return aggregates.first_per_group(read(spark, sf_dir, "orders"), ["o_custkey"], "o_orderkey", {"first_order": "o_orderkey", "first_status": "o_orderstatus"})


# Filters and predicates.
sql("filter_and_or", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity < 3 AND (l_returnflag = 'R' OR l_discount >= 0.09) AND l_linestatus <> 'O'", "lineitem")
sql("filter_between_in", "SELECT p_partkey, p_size FROM {part} WHERE p_size BETWEEN 10 AND 12 AND p_partkey IN (1, 5, 7, 11, 13, 40, 41, 42, 77, 100, 150, 200) OR p_size NOT BETWEEN 3 AND 49", "part")
sql("filter_null", "SELECT id FROM {tap_chat_logs} WHERE bot_reply IS NULL OR (latency_us IS NULL AND intent IS NOT NULL)", "tap_chat_logs")
sql("filter_columns", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_partkey = l_suppkey OR l_tax > l_discount AND l_quantity = 50", "lineitem")
sql("filter_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name ILIKE '%R_D %' AND p_brand NOT ILIKE 'brand#1%'", "part")
sql("filter_not", "SELECT p_partkey FROM {part} WHERE NOT (p_size > 5 OR p_type ILIKE '%e%')", "part")
sql("not_in_null_list", "SELECT p_partkey FROM {part} WHERE p_size NOT IN (1, 2, NULL)", "part")
sql("point_lookup", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_orderkey = 100 OR o_orderkey BETWEEN 200 AND 203", "orders")

# Joins.
sql("join_inner", "SELECT c_custkey, n_name FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey", "customer nation")
sql("join_left", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey", "customer orders")
sql("join_right", "SELECT n_nationkey, s_suppkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey", "supplier nation")
sql("join_full", "SELECT a.id AS ida, b.mem_id AS idb FROM (SELECT DISTINCT id FROM {tap_knowledge_base}) a FULL JOIN (SELECT DISTINCT mem_id FROM {device_memory}) b ON a.id = b.mem_id", "tap_knowledge_base device_memory")
sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}", "region nation")
sql("join_chain", """
    SELECT r_name, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    GROUP BY r_name""", "orders customer nation region")  # fmt: skip
sql("join_theta", "SELECT a.s_suppkey AS sa, b.s_suppkey AS sb FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal", "supplier")
sql("join_null_keys", "SELECT a.mem_id AS ida, b.mem_id AS idb FROM (SELECT DISTINCT mem_id, namespace FROM {device_memory}) a JOIN (SELECT DISTINCT mem_id, namespace FROM {device_memory}) b ON a.namespace = b.namespace AND a.mem_id = b.mem_id + 1", "device_memory")
sql("star_join", """
    SELECT n_name, p_brand, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS n
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey
    WHERE p_size < 20 GROUP BY n_name, p_brand""", "lineitem part supplier nation")  # fmt: skip

# Semi and anti joins, scalar subqueries.
sql("semi_exists", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)", "customer orders")
sql("anti_not_exists", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)", "customer orders")
sql("in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)", "supplier nation")
sql("not_in_subquery_null", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT CASE WHEN n_nationkey > 3 THEN NULL ELSE n_nationkey END FROM {nation})", "supplier nation")
sql("not_in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey < 3)", "supplier nation")
sql("scalar_subquery_where", "SELECT o_orderkey FROM {orders} WHERE o_totalprice > 1.9 * (SELECT avg(o_totalprice) FROM {orders})", "orders")
sql("scalar_subquery_correlated", "SELECT c_custkey, (SELECT count(*) FROM {orders} WHERE o_custkey = c_custkey) AS n FROM {customer} WHERE c_acctbal > (SELECT avg(s_acctbal) FROM {supplier} WHERE s_nationkey = c_nationkey)", "customer orders supplier")
sql("derived_table", "SELECT seg, avg_bal FROM (SELECT c_mktsegment AS seg, round(avg(c_acctbal), 4) AS avg_bal FROM {customer} GROUP BY c_mktsegment) t WHERE avg_bal > 0", "customer")
sql("select_without_from", "SELECT 1 + 2 AS a, 'x' || 'y' AS b, CASE WHEN 1 < 2 THEN 'yes' END AS c", "")

# Sorting and limits; ties are broken, so that the rows are the same.
sql("topk_sort", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM {lineitem} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20", "lineitem")
sql("limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice, o_orderkey LIMIT 10 OFFSET 25", "orders")
sql("sort_nulls_first", "SELECT id, category FROM (SELECT DISTINCT id, category FROM {tap_knowledge_base}) t ORDER BY category ASC NULLS FIRST, id LIMIT 15", "tap_knowledge_base")
sql("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM {lineitem}", "lineitem")
sql("alias_order", "SELECT p_brand AS brand, count(*) AS n FROM {part} GROUP BY p_brand ORDER BY n DESC, brand LIMIT 7", "part")

# Set operations.
sql("set_union", "SELECT c_nationkey AS k FROM {customer} UNION SELECT s_nationkey FROM {supplier}", "customer supplier")
sql("set_union_all", "SELECT c_nationkey AS k FROM {customer} UNION ALL SELECT s_nationkey FROM {supplier}", "customer supplier")
sql("set_intersect", "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey FROM {supplier}", "customer supplier")
sql("set_except", "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT n_regionkey FROM {nation}", "nation")


def _compound(spark, sf_dir):
    nation, region, customer = (read(spark, sf_dir, t) for t in ("nation", "region", "customer"))
    return setops.compound(
        nation.select(F.col("n_nationkey").alias("k")),
        ("union", region.select((F.col("r_regionkey") + 100).alias("k"))),
        ("intersect", customer.select(F.col("c_nationkey").alias("k"))),
        ("except", nation.select(F.col("n_regionkey").alias("k"))),
    )


@add("((SELECT n_nationkey AS k FROM nation UNION SELECT r_regionkey + 100 FROM region) INTERSECT SELECT c_nationkey FROM customer) EXCEPT SELECT n_regionkey FROM nation")
def compound_left_deep(spark, sf_dir):
    return _compound(spark, sf_dir)


# Common table expressions.
sql("cte_chain", "WITH a AS (SELECT o_custkey AS k, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), b AS (SELECT avg(t) AS m FROM a) SELECT k, round(t, 2) AS t FROM a, b WHERE t > 1.5 * m", "orders")
sql("cte_columns", "WITH a(x, y) AS (SELECT r_regionkey, r_name FROM {region}) SELECT y, x FROM a WHERE x > 1", "region")
sql("recursive_union_all", "WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", "")


@add("""
    WITH RECURSIVE e AS (SELECT DISTINCT n_nationkey AS src, (n_nationkey * 7 + n_regionkey) % 25 AS dst FROM nation),
    t(node) AS (SELECT 0 UNION SELECT dst FROM t JOIN e ON node = src) SELECT node FROM t""")
def recursive_union_cycle(spark, sf_dir):
    edges = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).alias("dst"))
    seed = spark.range(1).select(F.lit(0).alias("node"))
    return recursion.union_fixpoint(seed, lambda new: new.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")))


# Windows.
sql("win_rank", """
    SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderstatus) AS dr
    FROM {orders} WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)""", "orders")  # fmt: skip
sql("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS after2 FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)", "orders")
sql("win_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER w AS n FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "orders")
sql("win_frame", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 2) AS near FROM {orders}", "orders")
sql("win_ntile", "SELECT s_suppkey, ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS q FROM {supplier}", "supplier")
sql("win_values", "SELECT s_suppkey, first_value(s_suppkey) OVER w AS f, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM {supplier} WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)", "supplier")


@add("""
    SELECT s_suppkey, CAST((row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) * 4 // count(*) OVER (PARTITION BY s_nationkey) AS BIGINT) + 1 AS q FROM supplier""")
def win_ntile_compat(spark, sf_dir):
    return read(spark, sf_dir, "supplier").select("s_suppkey", windows.ntile(4, ["s_nationkey"], ["s_suppkey"], compat=True).alias("q"))


@add("""
    SELECT o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey), 0), 2) AS total, count(*) OVER (PARTITION BY o_custkey) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey) AS most FROM orders""")
def win_full_partition_agg(spark, sf_dir):
    w = windows.whole_partition(["o_custkey"])
    return read(spark, sf_dir, "orders").select("o_orderkey", F.round(windows.compat_sum("o_totalprice", ["o_custkey"]), 2).alias("total"), F.count(F.lit(1)).over(w).alias("n"), F.max("o_totalprice").over(w).alias("most"))


# Extensions: grouping sets, pivots.
sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)", "lineitem")
sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 200000), 2) AS big FROM {orders} GROUP BY o_orderpriority", "orders")
