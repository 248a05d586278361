"""Tables written to files of every format and read again, by functions and by statements."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from quillspark.dialect import Session
from quillspark.plans.registry import Registry, read
from quillspark.plans.stateful import new_store
from quillspark.session import shared_folder
from quillspark.sources import files, foreign, texts

add = Registry()
QUERIES, SQL = add.queries, add.sql


def _path(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _one_file(spark) -> str:
    """A path for a writer that makes one file by itself."""
    path = _path(spark).removeprefix("file://").removeprefix("file:")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return path


_SUPPLIER = "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier"


@add("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey = 7")
def lake_hive_partitions(spark, sf_dir):
    path = _path(spark)
    files.write(read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment"), path, "parquet", ["c_mktsegment", "c_nationkey"])
    return files.read_parquet(spark, f"{path}/c_mktsegment=*/c_nationkey=*").where("c_nationkey = 7").select("c_custkey", "c_nationkey", "c_mktsegment")


@add("SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem")
def lake_deep_glob(spark, sf_dir):
    path = _path(spark)
    files.write(read(spark, sf_dir, "lineitem").select("l_quantity", "l_returnflag"), path, "parquet", ["l_returnflag"])
    return files.read_parquet(spark, f"{path}/**/*.parquet").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))


def _round_trip(kind: str):
    def query(spark, sf_dir):
        path = _path(spark)
        files.write(read(spark, sf_dir, "supplier"), path, kind)
        return files.read_any(spark, path, kind).select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")

    return query


for _kind in ("csv", "tsv", "jsonl"):
    QUERIES[f"round_trip_{_kind}"], SQL[f"round_trip_{_kind}"] = _round_trip(_kind), _SUPPLIER


@add("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def csv_quoted_lines(spark, sf_dir):
    path = _path(spark)
    files.write(read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), path, "csv")
    return files.read_csv(spark, path)


@add("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def round_trip_xlsx(spark, sf_dir):
    path = _one_file(spark) + ".xlsx"
    foreign.write_xlsx(read(spark, sf_dir, "nation"), path)
    return files.read_any(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@add("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def round_trip_ods(spark, sf_dir):
    path = _one_file(spark) + ".ods"
    foreign.write_ods(read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal"), path, "suppliers")
    return Session(spark).sql(f"SELECT * FROM read_excel('{path}', 'suppliers')")


@add("SELECT c_custkey, c_name, c_acctbal FROM customer")
def read_sqlite(spark, sf_dir):
    import sqlite3

    path = _one_file(spark) + ".db"
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal").toLocalIterator()  # as SQLite's own writer takes them
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE customer (c_custkey INTEGER PRIMARY KEY, c_name TEXT, c_acctbal REAL)")
        con.executemany("INSERT INTO customer VALUES (?, ?, ?)", map(tuple, rows))
    return Session(spark).sql(f"SELECT * FROM read_sqlite('{path}', 'customer')")


def _dump(style: str):
    def query(spark, sf_dir):
        path = _path(spark)
        foreign.write_dump(read(spark, sf_dir, "supplier").coalesce(1), path, "supplier", style)
        whole = next(f for f in files.discover(path) if "part-" in f)
        ddl = next(f for f in files.discover(f"{path}.schema") if "part-" in f)
        joined = _one_file(spark) + ".sql"
        with open(joined, "w") as out:
            for f in (ddl, whole):
                with open(f) as part:
                    out.writelines(part)
        return foreign.read_dump(spark, joined, "supplier").selectExpr("s_suppkey", "s_name", "CAST(s_nationkey AS INT) AS s_nationkey", "s_acctbal")

    return query


for _style in ("insert", "copy"):
    QUERIES[f"dump_{_style}"], SQL[f"dump_{_style}"] = _dump(_style), _SUPPLIER


@add("SELECT count(*) AS rows_copied, (SELECT round(sum(s_acctbal), 2) FROM supplier) AS total FROM supplier")
def copy_to_and_from(spark, sf_dir):
    read(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    s, path = Session(spark, new_store(spark)), _path(spark)
    s.sql(f"COPY (SELECT s_suppkey, s_acctbal, s_nationkey FROM supplier) TO '{path}' (FORMAT parquet, PARTITION_BY s_nationkey)")
    copied = s.sql(f"COPY fresh FROM '{path}' (FORMAT parquet)").first()[0]
    return s.sql(f"SELECT CAST({copied} AS BIGINT) AS rows_copied, round(sum(s_acctbal), 2) AS total FROM fresh")


@add("SELECT count(*) AS n FROM supplier WHERE s_acctbal > 0")
def read_in_statement(spark, sf_dir):
    path = _path(spark)
    files.write(read(spark, sf_dir, "supplier"), path, "csv")
    return Session(spark).sql(f"SELECT count(*) AS n FROM read_csv('{path}') WHERE s_acctbal > 0 AND 'read_csv(''x'')' <> ''")


@add("SELECT count(*) AS n FROM orders")
def convert_formats(spark, sf_dir):
    a, b = _path(spark), _path(spark)
    files.write(read(spark, sf_dir, "orders"), a, "jsonl")
    n = files.convert(spark, a, b, "jsonl", "tsv")
    return spark.createDataFrame([(n,)], "n long")


@add("SELECT r_name AS heading, 'All nations of ' || r_name || '.' AS content FROM region")
def read_markdown(spark, sf_dir):
    path = _one_file(spark)
    os.makedirs(path)
    for i, r in enumerate(read(spark, sf_dir, "region").collect()):  # a handful of regions
        with open(f"{path}/{i}.md", "w") as f:
            f.write(f"# {r.r_name}\n\nAll nations of {r.r_name}.\n")
    return texts.read_text(spark, f"{path}/*.md").selectExpr("heading", "trim(replace(content, concat('# ', heading), '')) AS content")


@add("SELECT 2 * count(*) AS nodes, count(*) AS edges FROM region")
def markdown_graph(spark, sf_dir):
    path = _one_file(spark)
    os.makedirs(path)
    for i, r in enumerate(read(spark, sf_dir, "region").collect()):
        with open(f"{path}/{i}.md", "w") as f:
            f.write(f"# {r.r_name}\n\nAll nations of {r.r_name}.\n")
    nodes, edges = texts.chunk_graph(texts.read_text(spark, f"{path}/*.md"))
    return spark.createDataFrame([(nodes.count(), edges.count())], "nodes long, edges long")
