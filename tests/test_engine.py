import numpy as np
import pytest

from quillspark.dialect import Session
from quillspark.functions import dates, lite
from quillspark.graph import algorithms, chain, cypher, model
from quillspark.memory import recall as memory
from quillspark.operators import recursion, retrieval, setops, vectors, windows
from quillspark.tables.store import Rules, Store
from pyspark.sql import functions as F


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(str(i)) for i, c in enumerate(cols))).first())


def test_scalar_rules(spark):
    n = F.lit(None).cast("string")
    assert one(spark, lite.to_integer(F.lit("3.9")), lite.to_integer(F.lit("junk")), lite.to_integer(n), lite.to_real(F.lit("x")), lite.to_boolean(F.lit("YES"))) == (3, 0, None, 0.0, 1)
    assert one(spark, lite.int_divide(F.lit(-7), F.lit(2)), lite.int_divide(F.lit(1), F.lit(0)), lite.mod(F.lit(-7), F.lit(3)), lite.mod(F.lit(1), F.lit(0))) == (-3, None, -1, None)
    assert one(spark, lite.substr(F.lit("héllo"), -3, 2), lite.trim(F.lit("\t x ")), lite.trim(F.lit("xxaxx"), "x"), lite.hex_(F.lit("255")), lite.concat(F.lit("a"), n, F.lit("b"))) == ("hé", "x", "a", "323535", "ab")
    assert one(spark, lite.round_(F.lit(2.5)), lite.round_(F.lit(-2.5), -1), lite.to_text(F.lit(1.0), "double"), lite.sqrt(F.lit(-1.0)), lite.plus(F.lit(9223372036854775807), F.lit(1))) == (3.0, -3.0, "1", None, None)
    assert one(spark, lite.json_extract(F.lit('{"a": {"b": [1, true]}}'), "a.b.1"), lite.json_extract(F.lit("{broken"), "a"), lite.like(F.lit("ABC"), "a_c"), lite.match_any(F.lit("the Pump-1 runs"), "pump-1 x")) == ("1", None, True, True)


def test_date_rules(spark):
    assert one(spark, dates.date(F.lit("2024-01-31 10:20"), "+1 month"), dates.datetime(F.lit("2024-02-29T10:20:30"), "start of year"), dates.time(F.lit("08:09")), dates.date(F.lit("never"))) == ("2024-02-29", "2024-01-01 00:00:00", "08:09:00", None)
    assert one(spark, dates.unixepoch(F.lit("1970-01-02")), dates.julianday(F.lit("2000-01-01 12:00")), dates.datetime(F.lit("86400"), "unixepoch"), dates.strftime("%Y-%j %w %W%%", F.lit("2024-12-31"))) == (86400, 2451545.0, "1970-01-02 00:00:00", "2024-366 2 53%")
    with pytest.raises(ValueError):
        dates.date(F.lit("2024-01-01"), "sideways")


def test_windows_sets_and_recursion(spark):
    df = spark.range(6).withColumn("g", F.lit(1))
    assert [r.t for r in df.select("id", windows.ntile(4, ["g"], ["id"], compat=True).alias("t")).orderBy("id").collect()] == [1, 1, 2, 3, 3, 4]
    a, b, c = (spark.createDataFrame([(x,) for x in xs], "k int") for xs in ((1, 2), (3,), (1,)))
    assert [r.k for r in setops.compound(a, ("union", b), ("intersect", c)).collect()] == [1]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (9, 1)], "s int, d int")
    out = recursion.union_fixpoint(spark.createDataFrame([(1,)], "n int"), lambda new: new.join(edges, F.col("n") == F.col("s")).select("d"))
    assert sorted(r.n for r in out.collect()) == [1, 2, 3]


def test_vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 16)).astype("f4")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, v array<float>")
    q = x[7] + 0.01
    s = x @ q / np.linalg.norm(x, axis=1)
    assert [r.id for r in vectors.nearest(df, "v", q.tolist(), 5, "id").collect()] == np.argsort(-s)[:5].tolist()
    index = vectors.InvertedFile(vectors.sample_vectors(df, "id", "v"), 8)
    assert [r.id for r in index.nearest(index.assign(df, "v"), "v", q.tolist(), 5, "id", 8).collect()] == np.argsort(-s)[:5].tolist()
    pq = vectors.ProductQuantizer(vectors.sample_vectors(df, "id", "v"), 4, 64)
    assert 7 in [r.id for r in pq.nearest(pq.encode(df, "v"), x[7].tolist(), 5, "id").collect()]
    bits = vectors.BitQuantizer(16)
    assert bits.encode(df, "v").where("v is not null").select("id", bits.hamming("bits", x[7].tolist()).alias("h")).orderBy("h", "id").first().id == 7
    assert one(spark, vectors.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))), vectors.l2_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0), F.lit(2.0)))) == (1.0, 1.7976931348623157e308)
    e = retrieval.embed_text("The pump vibrates")
    assert abs(np.linalg.norm(e) - 1) < 1e-6 and not retrieval.embed_text("?!").any() and np.allclose(e, retrieval.embed_text("the PUMP, vibrates!"))


def graph(spark):
    nodes = spark.createDataFrame([(i, "P" if i < 5 else "Q", f'{{"name": "n{i}"}}') for i in range(1, 7)], "id long, label string, properties string")
    edges = spark.createDataFrame([(1, 2, "K", 1.0, "{}"), (2, 3, "K", 1.0, "{}"), (1, 3, "K", 5.0, "{}"), (3, 1, "K", 1.0, "{}"), (3, 4, "L", 2.0, "{}"), (5, 6, "L", 1.0, "{}")], "src long, dst long, label string, weight double, properties string")
    return model.Graph(nodes, edges)


def test_graph(spark):
    g = graph(spark)
    assert sorted(tuple(r) for r in algorithms.traverse(g, 1, "out", max_depth=3).select("node_id", "depth").collect()) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert [tuple(r)[1:3] for r in algorithms.shortest_path(g, 1, 4).collect()] == [(1, 2), (2, 3), (3, 4)]
    assert algorithms.shortest_path(g, 1, 6).count() == 0
    assert sorted(tuple(r) for r in algorithms.components(g.nodes, g.edges).collect()) == [(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5)]
    assert algorithms.triangles(g).first()[0] == 1
    ranks = {r.id: r["rank"] for r in algorithms.pagerank(g).collect()}
    assert abs(sum(ranks.values()) - 1) < 1e-6 and ranks[3] == max(ranks.values())
    assert {r.id: r.score for r in algorithms.betweenness(g, False).collect()}[3] == 3.0
    assert {r.id: r.community for r in algorithms.louvain(g).collect()}[6] == 5
    assert [r.n for r in cypher.run(g, "MATCH (a:P)-[:K]->(b) WHERE b.name = 'n3' RETURN a.name AS n LIMIT 9").orderBy("n").collect()] == ["n1", "n2"]
    assert cypher.run(g, "MATCH (a)<-[:L]-(b) RETURN count(*)").first()[0] == 2
    assert [r.id for r in chain.Chain(g, g.nodes.where("id = 1")).out("K").out("L").ids().collect()] == [4]
    seeds = spark.createDataFrame([(1, 0.9)], "id long, score double")
    assert [r.id for r in chain.graph_rag(g, seeds, "n4", 2).collect()][:1] == [1]
    assert cypher.create(g, "CREATE (:P {name: 'x'})").nodes.count() == 7 and g.without_nodes(g.nodes.where("id = 3")).edges.count() == 2


def test_memory(spark):
    row = lambda i, text, v, ts=100, ns="a", ext=None, exp=None: (i, text, v, ts, 0.5, [], [i + 1], ns, None, ext, "m", exp, 1, None)
    df = spark.createDataFrame([row(1, "pump valve", [1.0, 0.0]), row(2, "archive", [0.0, 1.0]), row(3, "pump", None, exp=50), row(4, "pump", [1.0, 0.1], ns="B", ext="e")], memory.SCHEMA)
    assert [r.id for r in memory.recall(df, "pump", [1.0, 0.0], now=100, scope=memory.Scope("A")).collect()] == [1]
    assert [r.id for r in memory.recall(df, "pump", now=100, hops=1, scope=memory.Scope("a")).collect()] == [1, 2]
    assert {r.id for r in memory.recall_fused(df, "archive", [1.0, 0.0], now=100).collect()} == {1, 2, 4}
    out = {r.id: r for r in memory.upsert(df, spark.createDataFrame([row(9, "new", None, ns="b", ext="e"), row(10, "x", None)], memory.SCHEMA), 200).collect()}
    assert out[4].content == "new" and out[4].revision == 2 and out[4].timestamp == 100 and out[10].timestamp == 200
    assert memory.forget(df, [2]).where("id = 1").first().associations == []


def test_dialect(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.create("acc", "id long, v array<float>, b long", Rules(["id"], versioned=True))
    store.insert("acc", spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [0.0, 1.0], 6)], "id long, v array<float>, b long"), now=100)
    store.update("acc", {"b": "0"}, now=200)
    s = Session(spark, store, graph(spark))
    assert [r.b for r in s.sql("SELECT b FROM acc AS OF TIMESTAMP 150 ORDER BY b").collect()] == [5, 6]
    assert [r.id for r in s.sql("SELECT id FROM acc VECTOR NEAR v = [0.1, 1] TOP 1").collect()] == [2]
    assert [r.id for r in s.sql("SELECT id FROM acc WHERE id > 0 ORDER BY v <-> '[1, 0]' LIMIT 1").collect()] == [1]
    assert s.sql(f"COPY (SELECT id, b FROM acc) TO '{tmp_path}/out' (FORMAT csv)").first()[0] == 2
    assert s.sql(f"SELECT sum(id) FROM read_csv('{tmp_path}/out')").first()[0] == 3
    assert s.sql(f"COPY fresh FROM '{tmp_path}/out' (FORMAT csv)").first()[0] == 2
    assert s.sql("GRAPH TRAVERSE FROM 1 OUT MAX_DEPTH 1").count() == 3
    assert s.sql("MATCH (a)-[:L]->(b) RETURN count(*)").first()[0] == 2
    assert s.sql("SELECT id FROM acc WHERE id = ?", [2]).count() == 1
