import gzip
import sqlite3

import pytest

from quillspark.sources import files, foreign, texts


def test_lake_pruning_and_statistics(spark, tmp_path):
    base = 0
    for year, region in ((2025, "EMEA"), (2026, "APAC"), (2026, "US")):
        rows = [(base + k, k, k * 1.5, f"{region}_{k % 4}") for k in range(1, 501)]
        spark.createDataFrame(rows, "id long, amount long, score double, cat string").coalesce(1).write.parquet(f"{tmp_path}/lake/year={year}/region={region}")
        base += 1000
    lake = files.read_parquet(spark, f"{tmp_path}/lake")
    assert lake.count() == 1500
    r = lake.where("year = 2026 and region = 'APAC' and amount > 420").selectExpr("count(*) c", "min(amount) lo", "max(amount) hi", "sum(amount) s").first()
    assert tuple(r) == (80, 421, 500, 36840)
    g = lake.where("year = 2026 and amount <= 100").groupBy("region").agg({"*": "count", "amount": "sum"}).collect()
    assert {(x["count(1)"], x["sum(amount)"]) for x in g} == {(100, 5050)}
    deep = files.read_parquet(spark, f"{tmp_path}/lake/**/*.parquet")
    assert deep.count() == 1500 and "region" in deep.columns
    assert [x.amount for x in lake.where("region='US'").orderBy("amount", ascending=False).offset(1).limit(2).collect()] == [499, 498]


def test_csv_sniffs_types_and_drops_ragged_rows(spark, tmp_path):
    p = tmp_path / "a.csv.gz"
    with gzip.open(p, "wt") as f:
        f.write('id;2nd name;value;value\n1;"a; ""b""";1.5;x\n2;;2;y\n3;c\n')
    df = files.read_csv(spark, str(p))
    assert df.columns == ["id", "c_2nd_name", "value", "value_2"]
    rows = [tuple(r) for r in df.orderBy("id").collect()]
    assert rows[0] == (1, 'a; "b"', 1.5, "x") and rows[1] == (2, None, 2.0, "y")
    assert dict(df.dtypes)["id"] == "bigint" and dict(df.dtypes)["value"] == "double"


def test_json_lines_and_arrays(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"b": 1, "a": "x"}\n{"a": null}\n')
    (tmp_path / "b.json").write_text('[{"b": 1, "a": "x"},\n {"b": 2}]')
    assert files.read_any(spark, str(tmp_path / "a.jsonl")).columns == ["a", "b"]
    assert files.read_any(spark, str(tmp_path / "b.json")).count() == 2


def test_sqlite_needs_a_table_and_reads_types(spark, tmp_path):
    p = str(tmp_path / "x.db")
    with sqlite3.connect(p) as c:
        c.execute("create table t (id integer, name text, v real, b blob)")
        c.executemany("insert into t values (?, ?, ?, ?)", [(1, "a", 1.5, b"\x01"), (2, None, None, None)])
    with pytest.raises(ValueError):
        foreign.read_sqlite(spark, p)
    assert [tuple(r) for r in foreign.read_sqlite(spark, p, "t").orderBy("id").collect()] == [(1, "a", 1.5, bytearray(b"\x01")), (2, None, None, None)]


def test_dump_of_three_kinds(spark, tmp_path):
    p = tmp_path / "d.sql"
    p.write_text("-- x\nSET a = 1;\nCREATE TABLE public.t (id integer NOT NULL, name text, PRIMARY KEY (id));\nCOPY public.t (id, name) FROM stdin;\n1\ta\\tb\n2\t\\N\n\\.\n")
    assert [tuple(r) for r in foreign.read_dump(spark, str(p)).collect()] == [(1, "a\tb"), (2, None)]
    p.write_text("CREATE TABLE `t` (`id` int, `s` varchar(9), d decimal(4,2));\nINSERT INTO `t` VALUES (1,'it''s; (x)',1.5),(2,NULL,NULL);\n")
    assert [tuple(r) for r in foreign.read_dump(spark, str(p), "t").collect()] == [(1, "it's; (x)", 1.5), (2, None, None)]


def test_spreadsheet_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b", 1.5), (2, None, 2.0)], "id long, s string, v double")
    assert foreign.write_xlsx(df, str(tmp_path / "a.xlsx")) == 2
    assert [tuple(r) for r in files.read_any(spark, str(tmp_path / "a.xlsx")).orderBy("id").collect()] == [(1, "a<b", 1.5), (2, None, 2.0)]


def test_text_chunks(spark, tmp_path):
    text = "# One\n" + "A sentence here. " * 200 + "\n## Two\nshort"
    (tmp_path / "a.md").write_text(text)
    rows = texts.read_text(spark, str(tmp_path / "a.md")).orderBy("chunk_index").collect()
    assert {r.heading for r in rows} == {"One", "Two"} and all(0 < r.char_count <= 1200 for r in rows)
    assert texts.chunk("") == [] and texts.chunk("x" * 3000)[0] == "x" * 1200
    nodes, edges = texts.chunk_graph(texts.read_text(spark, str(tmp_path / "a.md")))
    assert edges.count() == len(rows) and nodes.count() == len(rows) + 2


def test_writers_and_conversion(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,\"b\"", float("nan")), (2, None, 2.0)], "id long, s string, v double")
    files.write(df, str(tmp_path / "j"), "jsonl")
    assert sorted(x.value for x in spark.read.text(str(tmp_path / "j")).collect()) == ['{"id":1,"s":"a,\\"b\\"","v":null}', '{"id":2,"s":null,"v":2.0}']
    files.write(df.select("id", "s"), str(tmp_path / "c"), "csv")
    assert files.convert(spark, str(tmp_path / "c"), str(tmp_path / "p"), "csv") == 2
    foreign.write_dump(df.select("id", "s"), str(tmp_path / "d"), "t")
    assert spark.read.text(str(tmp_path / "d")).count() == 2


def test_names_and_formats():
    assert files.clean_names(["a b", "", "1x", "A b", None]) == ["a_b", "col_1", "c_1x", "A_b_2", "col_4"]
    assert files.infer_format("x/y.CSV.gz") == "csv"
    with pytest.raises(ValueError):
        files.infer_format("x.bin")
