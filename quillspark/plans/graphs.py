"""Graph queries over a graph derived from the test tables: customer to nation, supplier to nation, nation to region, nation to nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.graph import algorithms, chain, cypher, model
from quillspark.plans.registry import Registry, read

add = Registry()
QUERIES, SQL = add.queries, add.sql

#: Offsets that keep the ids of the tables apart.
NATION, SUPPLIER, CUSTOMER = 1_000, 10_000, 1_000_000


def _graph(spark, sf_dir) -> model.Graph:
    region, nation, supplier, customer = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier", "customer"))
    nid = F.col("n_nationkey").cast("long") + NATION
    nodes = (
        model.nodes_from(region, F.col("r_regionkey").cast("long"), "Region", ["r_name"])
        .unionByName(model.nodes_from(nation, nid, "Nation", ["n_name"]))
        .unionByName(model.nodes_from(supplier, F.col("s_suppkey") + SUPPLIER, "Supplier", ["s_name", "s_acctbal"]))
        .unionByName(model.nodes_from(customer, F.col("c_custkey") + CUSTOMER, "Customer", ["c_mktsegment"]))
    )
    edges = (
        model.edges_from(nation, nid, F.col("n_regionkey").cast("long"), "IN")
        .unionByName(model.edges_from(nation, nid, ((F.col("n_nationkey") * 7 + F.col("n_regionkey")) % 25).cast("long") + NATION, "TRADES", (F.col("n_nationkey") % 4 + 1)))
        .unionByName(model.edges_from(supplier, F.col("s_suppkey") + SUPPLIER, F.col("s_nationkey").cast("long") + NATION, "LOCATED", F.lit(2.0)))
        .unionByName(model.edges_from(customer, F.col("c_custkey") + CUSTOMER, F.col("c_nationkey").cast("long") + NATION, "LIVES", F.lit(3.0)))
    )
    return model.Graph(nodes, edges)


_E = f"""
    nodes AS (SELECT r_regionkey::BIGINT AS id FROM region UNION ALL SELECT n_nationkey + {NATION} FROM nation UNION ALL SELECT s_suppkey + {SUPPLIER} FROM supplier UNION ALL SELECT c_custkey + {CUSTOMER} FROM customer),
    e AS (
        SELECT n_nationkey::BIGINT + {NATION} AS src, n_regionkey::BIGINT AS dst, 1.0::DOUBLE AS w FROM nation
        UNION ALL SELECT n_nationkey + {NATION}, (n_nationkey * 7 + n_regionkey) % 25 + {NATION}, n_nationkey % 4 + 1 FROM nation
        UNION ALL SELECT s_suppkey + {SUPPLIER}, s_nationkey + {NATION}, 2.0 FROM supplier
        UNION ALL SELECT c_custkey + {CUSTOMER}, c_nationkey + {NATION}, 3.0 FROM customer)"""


@add(f"SELECT s_suppkey + {SUPPLIER} AS supplier, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 5000")
def graph_match(spark, sf_dir):
    m = model.match(_graph(spark, sf_dir), a_label="supplier", r_label="LOCATED", b_label="Nation")
    return m.where(model.value("a", "s_acctbal").cast("double") > 5000).select(F.col("a.id").alias("supplier"), model.value("b", "n_name").alias("nation"))


@add(f"WITH {_E} SELECT id, count(src) AS degree FROM nodes LEFT JOIN (SELECT dst AS id, src FROM e) USING (id) GROUP BY id")
def graph_degree(spark, sf_dir):
    return _graph(spark, sf_dir).degree("in")


@add(f"WITH RECURSIVE {_E}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), b(id, d) AS (SELECT {NATION + 3}::BIGINT, 0 UNION SELECT u.b, d + 1 FROM b JOIN u ON b.id = u.a WHERE d < 3) SELECT id AS node_id, min(d) AS depth FROM b GROUP BY id")
def graph_bfs_depth(spark, sf_dir):
    return algorithms.traverse(_graph(spark, sf_dir), NATION + 3, "both", max_depth=3).select("node_id", "depth")


@add(f"WITH RECURSIVE {_E}, b(id, d) AS (SELECT {NATION + 3}::BIGINT, 0 UNION SELECT dst, d + 1 FROM b JOIN e ON b.id = src WHERE d < 2 AND dst < {SUPPLIER} AND dst >= {NATION}) SELECT id AS node_id, min(d) AS depth FROM b GROUP BY id")
def graph_traverse_pruned(spark, sf_dir):
    return algorithms.traverse(_graph(spark, sf_dir), NATION + 3, "out", max_depth=2, where="label = 'Nation'").select("node_id", "depth")


@add(f"""
    WITH RECURSIVE {_E}, b(id, c, n) AS (SELECT {CUSTOMER + 1}::BIGINT, 0.0::DOUBLE, 0 UNION SELECT dst, c + w, n + 1 FROM b JOIN e ON b.id = src WHERE n < 40) SELECT id, round(min(c), 4) AS cost FROM b GROUP BY id""")
def graph_shortest_costs(spark, sf_dir):
    return algorithms.shortest_paths(_graph(spark, sf_dir), CUSTOMER + 1).select("id", F.round("cost", 4).alias("cost"))


@add()
def graph_shortest_path(spark, sf_dir):
    return algorithms.shortest_path(_graph(spark, sf_dir), CUSTOMER + 1, 2)


@add()
def graph_pagerank(spark, sf_dir):
    return algorithms.pagerank(_graph(spark, sf_dir)).select("id", F.round("rank", 6).alias("rank"))


@add(f"WITH RECURSIVE {_E}, u AS (SELECT n_nationkey AS a, n_nationkey AS b FROM nation UNION SELECT s_nationkey, s_nationkey FROM supplier), r AS (SELECT n_nationkey + {NATION} AS id, n_regionkey AS c FROM nation) SELECT count(*) AS triangles FROM (SELECT DISTINCT least(x.src, x.dst) AS a, greatest(x.src, x.dst) AS b FROM e x WHERE src <> dst) p JOIN (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst) q ON p.a = q.a AND p.b < q.b JOIN (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst) t ON t.a = p.b AND t.b = q.b")
def graph_triangles(spark, sf_dir):
    return algorithms.triangles(_graph(spark, sf_dir))


@add()
def graph_components(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return algorithms.components(g.nodes, g.edges)


@add()
def graph_betweenness(spark, sf_dir):
    return algorithms.betweenness(_graph(spark, sf_dir)).select("id", F.round("score", 9).alias("score"))


@add()
def graph_louvain(spark, sf_dir):
    return algorithms.louvain(_graph(spark, sf_dir))


@add(f"SELECT n_name AS nation, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 1000 GROUP BY n_name")
def cypher_count(spark, sf_dir):
    return cypher.run(_graph(spark, sf_dir), "MATCH (s:Supplier)-[l:LOCATED]->(n:Nation) WHERE s.s_acctbal > 1000 RETURN n.n_name AS nation, count(*) AS n")


@add(f"""
    WITH {_E}, s AS (SELECT DISTINCT src, dst FROM e WHERE src BETWEEN {NATION} AND {SUPPLIER - 1} AND dst >= {NATION}),
    two AS (SELECT src, dst, 1 AS h FROM s UNION SELECT a.src, b.dst, 2 FROM s a JOIN s b ON a.dst = b.src)
    SELECT x.n_name AS a, y.n_name AS b FROM (SELECT DISTINCT src, dst FROM two) t JOIN nation x ON x.n_nationkey + {NATION} = src JOIN nation y ON y.n_nationkey + {NATION} = dst""")
def cypher_variable_length(spark, sf_dir):
    return cypher.run(_graph(spark, sf_dir), "MATCH (x:Nation)-[t:TRADES*1..2]->(y:Nation) RETURN x.n_name AS a, y.n_name AS b")


@add(f"""
    SELECT DISTINCT c.c_custkey + {CUSTOMER} AS id FROM supplier s JOIN customer c ON c.c_nationkey = s.s_nationkey WHERE s.s_suppkey < 5 AND c.c_mktsegment = 'BUILDING'""")
def graph_chain(spark, sf_dir):
    g = _graph(spark, sf_dir)
    seeds = g.nodes.where(F.col("id").between(SUPPLIER, SUPPLIER + 4)).select("id")
    return chain.Chain(g, seeds).out("LOCATED").in_("LIVES").filter_property("c_mktsegment", "BUILDING").ids()


# The graph with trade: customer to supplier, weighted by the line items between them.
def _trade(spark, sf_dir) -> model.Graph:
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    sold = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_suppkey").agg(F.count(F.lit(1)).alias("w"))
    g = _graph(spark, sf_dir)
    return g.with_edges(model.edges_from(sold, F.col("o_custkey") + CUSTOMER, F.col("l_suppkey") + SUPPLIER, "BUYS", F.col("w")))


_T = _E + f""",
    t AS (SELECT src, dst, w FROM e UNION ALL SELECT o_custkey + {CUSTOMER}, l_suppkey + {SUPPLIER}, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def _ranks_sql(rounds: int) -> str:
    ctes = [_T, "n AS (SELECT count(*)::DOUBLE AS n FROM nodes)", "d AS (SELECT src, count(*) AS deg FROM t GROUP BY src)", "s AS MATERIALIZED (SELECT t.src, dst, 1.0 / deg AS share FROM t JOIN d ON t.src = d.src)", "r0 AS MATERIALIZED (SELECT id, 1 / n AS rank FROM nodes, n)"]
    for i in range(rounds):
        ctes.append(f"l{i} AS MATERIALIZED (SELECT coalesce(sum(rank), 0) AS lost FROM r{i} WHERE id NOT IN (SELECT src FROM d))")
        ctes.append(f"r{i + 1} AS MATERIALIZED (SELECT id, 0.15 / n + 0.85 * (coalesce(got, 0) + lost / n) AS rank FROM r{i} LEFT JOIN (SELECT dst AS id, sum(share * rank) AS got FROM s JOIN r{i} ON src = id GROUP BY dst) USING (id), n, l{i})")
    return f"WITH {', '.join(ctes)} SELECT id, round(rank, 8) AS rank FROM r{rounds}"


@add(_ranks_sql(20))
def graph_pagerank_rounds(spark, sf_dir):
    return algorithms.pagerank(_trade(spark, sf_dir), tolerance=0.0).select("id", F.round("rank", 8).alias("rank"))


@add(f"WITH {_T} SELECT id, count(src) AS degree FROM nodes LEFT JOIN t ON id = src GROUP BY id")
def graph_degree_out(spark, sf_dir):
    return _trade(spark, sf_dir).degree("out")


@add(f"WITH {_T} SELECT src AS id, dst AS neighbour, w AS weight FROM t WHERE dst BETWEEN {SUPPLIER} AND {CUSTOMER - 1}")
def graph_neighbours(spark, sf_dir):
    g = _trade(spark, sf_dir)
    return g.neighbours(g.nodes.where("label = 'Customer'").select("id"), "out", "buys").select("id", "neighbour", "weight")


@add(f"WITH {_T} SELECT count(*) AS edges, (SELECT count(*) FROM nodes) - 25 AS nodes FROM t WHERE NOT (src BETWEEN {NATION} AND {NATION + 24}) AND NOT (dst BETWEEN {NATION} AND {NATION + 24})")
def graph_remove_nodes(spark, sf_dir):
    g = _trade(spark, sf_dir)
    left = g.without_nodes(g.nodes.where("label = 'Nation'").select("id"))
    return left.edges.agg(F.count(F.lit(1)).alias("edges")).crossJoin(left.nodes.agg(F.count(F.lit(1)).alias("nodes")))


@add(f"WITH {_T} SELECT count(*) AS edges FROM t WHERE NOT src BETWEEN {SUPPLIER} AND {CUSTOMER - 1}")
def graph_remove_edges(spark, sf_dir):
    g = _trade(spark, sf_dir)
    return g.without_edges(g.edges.where("label = 'LOCATED'"), "located").edges.agg(F.count(F.lit(1)).alias("edges"))


@add(f"""
    WITH RECURSIVE {_E}, b(id, d) AS (SELECT {CUSTOMER + 1}::BIGINT, 0 UNION SELECT dst, d + 1 FROM b JOIN e ON b.id = src WHERE d < 6) SELECT max(d) AS steps FROM (SELECT id, min(d) AS d FROM b GROUP BY id) WHERE id = 2""")
def graph_path_unweighted(spark, sf_dir):
    return algorithms.shortest_path(_graph(spark, sf_dir), CUSTOMER + 1, 2, weighted=False).agg(F.max("step").alias("steps"))


@add(f"WITH RECURSIVE {_E}, b(id, c, n) AS (SELECT {CUSTOMER + 1}::BIGINT, 0.0::DOUBLE, 0 UNION SELECT dst, c + w, n + 1 FROM b JOIN e ON b.id = src WHERE n < 40) SELECT round(min(c), 4) AS cost FROM b WHERE id = 2")
def graph_path_cost(spark, sf_dir):
    return algorithms.shortest_path(_graph(spark, sf_dir), CUSTOMER + 1, 2).agg(F.round(F.max("total_cost"), 4).alias("cost"))


@add(f"""
    WITH RECURSIVE {_E}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), b(id, d) AS (SELECT 2::BIGINT, 0 UNION SELECT u.b, d + 1 FROM b JOIN u ON b.id = u.a WHERE d < 2), s AS (SELECT DISTINCT id FROM b)
    SELECT (SELECT count(*) FROM s) AS nodes, count(*) AS edges FROM e WHERE src IN (SELECT id FROM s) AND dst IN (SELECT id FROM s)""")
def graph_subgraph(spark, sf_dir):
    s = algorithms.subgraph(_graph(spark, sf_dir), 2, 2)
    return s.nodes.agg(F.count(F.lit(1)).alias("nodes")).crossJoin(s.edges.agg(F.count(F.lit(1)).alias("edges")))


@add(f"WITH {_E} SELECT a.id AS src, b.id AS dst, EXISTS (SELECT 1 FROM e WHERE src = a.id AND dst = b.id) AS found FROM nodes a, nodes b WHERE a.id BETWEEN {NATION} AND {NATION + 24} AND b.id < 5")
def graph_has_edges(spark, sf_dir):
    g = _graph(spark, sf_dir)
    pairs = g.nodes.where("label = 'Nation'").select(F.col("id").alias("src")).crossJoin(F.broadcast(g.nodes.where("label = 'Region'").select(F.col("id").alias("dst"))))  # five regions
    return algorithms.has_edges(g, pairs)


@add(f"SELECT s_suppkey + {SUPPLIER} AS id, 1.0::DOUBLE AS score FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 1")
def chain_matches(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return chain.Chain(g, g.nodes.where("id = 1").select("id")).in_("IN").in_("LOCATED").matches().select("id", "score")


@add(f"WITH RECURSIVE {_E} SELECT n_nationkey + {NATION} AS id, 1 AS depth FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1, 0")
def graph_rag_filtered(spark, sf_dir):
    g = _graph(spark, sf_dir)
    open_ = model.Graph(g.nodes.withColumn("properties", F.when(F.col("label").isin("Nation", "Region"), F.regexp_replace("properties", r"^\{", '{"tenant": "t", ')).otherwise(F.col("properties"))), g.edges.where("label = 'IN'"))
    seeds = spark.createDataFrame([(1, 0.9), (CUSTOMER + 1, 0.8)], "id long, score double")
    return chain.graph_rag(open_, seeds, "nation", hops=1, limit=1000, tenant="t").select("id", "depth")


@add(f"SELECT count(*) + 2 AS nodes, (SELECT count(*) FROM region) AS old FROM region")
def cypher_create(spark, sf_dir):
    g = cypher.create(cypher.create(_graph(spark, sf_dir), "CREATE (:Region {r_name: 'NEW'})"), "CREATE (:Region {r_name: 'NEWER'})")
    n = g.nodes.where("label = 'Region'").count()
    return spark.createDataFrame([(n, g.nodes.where("label = 'Region' and properties not like '%NEW%'").count())], "nodes long, old long")
