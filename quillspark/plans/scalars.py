"""Scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import dates, lite
from quillspark.plans.registry import Registry, read

add = Registry()
QUERIES, SQL = add.queries, add.sql


@add("""
    SELECT p_partkey, upper(p_name) AS up, lower(p_brand) AS low, length(p_name) AS len, concat(p_name, NULL, '-', p_size) AS joined, substr(p_name, 1, 3) AS head, substr(p_name, 4) AS rest,
        trim(E'\\t' || p_type || '  ', E' \\t') AS trimmed, reverse(p_brand) AS back, replace(p_name, 'a', 'A') AS swapped, instr(p_name, 'e') AS at, hex(p_brand) AS hx
    FROM part""")
def fn_strings(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_brand").alias("low"), F.length("p_name").cast("long").alias("len"), lite.concat("p_name", F.lit(None), F.lit("-"), "p_size").alias("joined"),
        lite.substr("p_name", -2, 3).alias("head"), lite.substr("p_name", 4).alias("rest"), lite.trim(F.concat(F.lit("\t"), "p_type", F.lit("  "))).alias("trimmed"), F.reverse("p_brand").alias("back"),
        F.replace("p_name", F.lit("a"), F.lit("A")).alias("swapped"), F.instr("p_name", "e").cast("long").alias("at"), lite.hex_("p_brand").alias("hx"),
    )


@add("""
    SELECT p_partkey, abs(p_size - 25) AS a, round(p_retailprice / 7, 2) AS r, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, CASE WHEN p_size > 25 THEN round(sqrt(p_size - 25), 6) END AS sq,
        power(p_size, 2)::DOUBLE AS pw, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % (p_size % 3) END AS m, CASE WHEN p_size = 25 THEN NULL ELSE p_partkey // (p_size - 25) END AS q
    FROM part""")
def fn_math(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.abs(F.col("p_size") - 25).alias("a"), lite.round_(F.col("p_retailprice") / 7, 2).alias("r"), lite.floor("p_retailprice").alias("f"), lite.ceil("p_retailprice").alias("c"),
        F.round(lite.sqrt(F.nullif(F.greatest(F.col("p_size") - 25, F.lit(0)), F.lit(0))), 6).alias("sq"), F.power("p_size", F.lit(2)).alias("pw"),
        lite.mod("p_size", F.col("p_size") % 3).alias("m"), lite.int_divide("p_partkey", F.col("p_size") - 25).alias("q"),
    )


@add("""
    SELECT id, CASE WHEN created_at IS NULL THEN NULL ELSE coalesce(trunc(try_cast(trim(created_at) AS DOUBLE))::BIGINT, 0) END AS as_int,
        CASE WHEN created_at IS NULL THEN NULL ELSE coalesce(try_cast(trim(created_at) AS DOUBLE), 0.0) END AS as_real, CAST(id AS VARCHAR) AS as_text, CASE WHEN is_safe = 1 THEN 1 ELSE 0 END::BIGINT AS as_bool
    FROM (SELECT DISTINCT id, created_at, is_safe FROM tap_chat_logs)""")
def fn_cast(spark, sf_dir):
    t = read(spark, sf_dir, "tap_chat_logs").select("id", "created_at", "is_safe").distinct()
    return t.select("id", lite.to_integer("created_at").alias("as_int"), lite.to_real("created_at").alias("as_real"), lite.to_text("id", "bigint").alias("as_text"), lite.to_boolean("is_safe").alias("as_bool"))


@add("""
    SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, strftime(o_orderdate, '%H:%M:%S') AS t, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d %H:%M:%S') AS som,
        strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d') AS next_month, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS ue, round(epoch_ms(o_orderdate) / 86400000.0 + 2440587.5, 6) AS jd,
        strftime(o_orderdate, '%j/%w') AS dw
    FROM orders""")
def fn_dates(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", dates.date(text).alias("d"), dates.time(text).alias("t"), dates.datetime(text, "start of month").alias("som"), dates.date(text, "+1 month").alias("next_month"),
        dates.unixepoch(text).alias("ue"), F.round(dates.julianday(text), 6).alias("jd"), dates.strftime("%j/%w", text).alias("dw"),
    )


@add("""
    SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'small' END AS size, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code,
        CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'open' END AS state, nullif(o_orderpriority, '1-URGENT') AS p, coalesce(nullif(o_orderstatus, 'O'), '-') AS s
    FROM orders""")
def fn_case_iif(spark, sf_dir):
    price, status = F.col("o_totalprice"), F.col("o_orderstatus")
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(price > 200000, "big").when(price > 50000, "mid").otherwise("small").alias("size"), F.when(status == "F", 1).when(status == "O", 2).alias("code"),
        lite.iif(status == "F", F.lit("done"), F.lit("open")).alias("state"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"), F.coalesce(F.nullif(status, F.lit("O")), F.lit("-")).alias("s"),
    )


@add("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def fn_json(spark, sf_dir):
    k = lite.json_extract("props", "k")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k")).where(k.try_cast("bigint") >= 50)


@add("""
    SELECT doc_id FROM documents
    WHERE len(list_intersect(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_-]+'), lambda t: strlen(t) > 1), ['vector', 'kabel-kabel', 'pompe'])) > 0""".replace("\\\\", "\\"))
def match_any(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(lite.match_any("text", "Vector, kabel-kabel pompe!")).select("doc_id")


@add("SELECT s_suppkey, 'Supplier ' || s_suppkey AS label, s_suppkey * 2 + 1 AS odd FROM supplier WHERE s_suppkey * 2 + 1 > 20")
def user_function(spark, sf_dir):
    lite.register_scalar(spark, "twice_plus_one", lambda x: x * 2 + 1, "long")
    read(spark, sf_dir, "supplier").createOrReplaceTempView("quill_supplier")
    return spark.sql("SELECT s_suppkey, 'Supplier ' || s_suppkey AS label, twice_plus_one(s_suppkey) AS odd FROM quill_supplier WHERE twice_plus_one(s_suppkey) > 20")


@add("SELECT s_suppkey, trim(s_name) AS name, s_suppkey // 7 AS q, CASE WHEN s_acctbal >= 0 THEN round(sqrt(s_acctbal), 4) END AS root FROM supplier WHERE s_name ILIKE '%1%'")
def sql_functions(spark, sf_dir):
    lite.register(spark)
    read(spark, sf_dir, "supplier").createOrReplaceTempView("quill_supplier")
    return spark.sql("SELECT s_suppkey, lite_trim(s_name) AS name, lite_idiv(s_suppkey, 7) AS q, round(lite_sqrt(s_acctbal), 4) AS root FROM quill_supplier WHERE lite_like(s_name, '%1%')")
