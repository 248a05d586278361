"""Queries over whole tables, with rows beyond any small id."""

import os

import pytest

from quillspark.plans import catalogue

SOME = "/root/testdata/sf0.01"
WHOLE = ("upsert_merge", "delete_returning", "time_travel", "join_null_keys", "join_full", "set_union_all", "set_intersect", "set_except", "compound_left_deep")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SOME):
        pytest.skip("the test tables aren't here")
    con = duckdb.connect()
    for f in os.listdir(SOME):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SOME}/{f}'")
    df = catalogue.queries()[name](spark, SOME)
    r = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert names == df.columns
    order = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in x) for x in rows), key=str)
    got = order(df.collect())
    assert got == order(r.fetchall())
    if name in ("upsert_merge", "delete_returning", "time_travel"):
        assert max(x[0] for x in got) > 500


def test_components_hold_every_node(spark, tmp_path):
    nations = [(n, f"n{n}", n % 3) for n in range(25)]
    tables = {
        "region": ([(r, f"r{r}") for r in range(4)], "r_regionkey int, r_name string"),
        "nation": (nations, "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, f"s{k}", k % 30, 1.0) for k in range(1, 40)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "customer": ([(k, k % 31, "BUILDING") for k in range(1, 700)], "c_custkey long, c_nationkey int, c_mktsegment string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    edges = [(1000 + n, r) for n, _, r in nations] + [(1000 + n, 1000 + (n * 7 + r) % 25) for n, _, r in nations]
    edges += [(10_000 + k, 1000 + n) for k, _, n, _ in tables["supplier"][0]] + [(1_000_000 + k, 1000 + n) for k, n, _ in tables["customer"][0]]
    least: dict = {}
    for x in [*range(4), *(1000 + n for n in range(25)), *(10_000 + k for k in range(1, 40)), *(1_000_000 + k for k in range(1, 700)), *(v for e in edges for v in e)]:
        least[x] = x
    moved = True
    while moved:  # brute force
        moved = False
        for a, b in edges:
            m = min(least[a], least[b])
            moved |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    got = {r.id: r.component for r in catalogue.queries()["graph_components"](spark, str(tmp_path)).collect()}
    assert got == {k: v for k, v in least.items() if k < 1000 + 25 or k >= 10_000}
