"""Iterative graph algorithms: each round is a plan of joins and aggregates, written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.graph.model import Graph
from quillspark.session import checkpointed

LEAST_WEIGHT = 0.0001


def traverse(graph: Graph, start: int, direction: str = "both", label: str | None = None, max_depth: int = 1, where: Column | str | None = None) -> DataFrame:
    """node_id, label, properties, depth by breadth; where prunes: a node that fails it isn't expanded or returned, the start excepted.

    A start that isn't a node gives no rows; the depth is at least 1.
    """
    allowed = graph.nodes if where is None else graph.nodes.where(where)
    steps = graph.steps(direction, label).select("here", "there")
    seen = graph.nodes.where(F.col("id") == start).select("id", F.lit(0).alias("depth"))
    edge = seen = checkpointed(seen)
    for depth in range(1, max(1, max_depth) + 1):
        new = edge.select(F.col("id").alias("here")).join(steps, "here").select(F.col("there").alias("id")).distinct()
        new = new.join(allowed.select("id"), "id", "left_semi").join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth))
        edge = checkpointed(new)
        if edge.isEmpty():
            break
        seen = seen.unionAll(edge)
    return seen.join(graph.nodes.dropDuplicates(["id"]), "id").select(F.col("id").alias("node_id"), "label", "properties", "depth")


def shortest_paths(graph: Graph, start: int, weighted: bool = True, max_rounds: int = 10_000) -> DataFrame:
    """id, cost, parent, hops of every node reached from start over outgoing edges; weights below 0.0001 count as that.

    Bellman-Ford: only nodes whose cost fell go on. Of equally cheap ways the one over the smaller parent wins.
    """
    cost = F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(LEAST_WEIGHT)) if weighted else F.lit(1.0)
    steps = checkpointed(graph.steps("out").groupBy("here", "there").agg(F.min(cost).alias("w")))
    known = checkpointed(graph.nodes.where(F.col("id") == start).limit(1).select("id", F.lit(0.0).alias("cost"), F.lit(None).cast("long").alias("parent"), F.lit(0).alias("hops")))
    edge = known
    for _ in range(max_rounds):
        offers = edge.select(F.col("id").alias("here"), "cost", "hops").join(steps, "here").select(F.col("there").alias("id"), (F.col("cost") + F.col("w")).alias("cost"), F.col("here").alias("parent"), (F.col("hops") + 1).alias("hops"))
        best = offers.groupBy("id").agg(F.min(F.struct("cost", "parent", "hops")).alias("x")).select("id", "x.*")
        old = known.select("id", F.col("cost").alias("old"))
        edge = checkpointed(best.join(old, "id", "left").where("old is null or cost < old").drop("old"))
        if edge.isEmpty():
            return known
        known = checkpointed(known.join(edge.select("id"), "id", "left_anti").unionByName(edge))
    raise RuntimeError("the paths didn't settle")


def shortest_path(graph: Graph, start: int, end: int, weighted: bool = True) -> DataFrame:
    """step, from_id, to_id, weight, total_cost of one cheapest way; no rows if there is none."""
    known = shortest_paths(graph, start, weighted)
    spark, rows, at = known.sparkSession, [], end
    tree = known.where(F.col("id") == end)
    found = tree.first()
    while found is not None and found.parent is not None:  # as many lookups as the way has steps
        before = known.where(F.col("id") == found.parent).first()
        rows.append((before.id, at, found.cost - before.cost, found.cost))
        at, found = before.id, before
    rows.reverse()
    return spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "step int, from_id long, to_id long, weight double, total_cost double")


def pagerank(graph: Graph, damping: float = 0.85, iterations: int = 20, tolerance: float = 1e-4) -> DataFrame:
    """id, rank; dangling mass is spread evenly, parallel edges count each, the loop ends early under the tolerance (L1)."""
    d = min(0.99, max(0.01, damping))
    nodes = checkpointed(graph.nodes.select("id").distinct())
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    out = graph.edges.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    nodes = checkpointed(nodes.join(out.select(F.col("src").alias("id"), F.lit(False).alias("_sends")), "id", "left").select("id", F.col("_sends").isNull().alias("dangling")))
    edges = checkpointed(graph.edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m")).join(out, "src").select("src", "dst", (F.col("m") / F.col("deg")).alias("share")))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    lost = ranks.agg(F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()[0]
    for _ in range(iterations):
        sent = edges.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("share") * F.col("rank")).alias("got"))
        new = ranks.join(sent, "id", "left").select("id", "dangling", ((1 - d) / n + d * (F.coalesce("got", F.lit(0.0)) + lost / n)).alias("rank"), F.col("rank").alias("old"))
        new = checkpointed(new)
        # One pass gives the movement of this round and the dangling mass of the next.
        moved, lost = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), F.coalesce(F.sum(F.when(F.col("dangling"), F.col("rank"))), F.lit(0.0))).first()
        ranks = new.select("id", "dangling", "rank")
        if moved < tolerance:
            break
    return ranks.select("id", "rank")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """id, component (the least id in it) of an undirected graph, by alternating large and small stars.

    Every round links each node's larger neighbours, then its smaller ones, to the least; the number of rounds grows
    with the logarithm of the longest chain, and a node's neighbours are never gathered.
    """
    e = checkpointed(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = checkpointed(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b"), F.col("m"), F.col("a"))
        linked = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b")))
        e = checkpointed(linked.where("a <> b").distinct())
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    low = e.groupBy("a").agg(F.min("b").alias("m"))
    return nodes.select("id").distinct().join(low.withColumnRenamed("a", "id"), "id", "left").select("id", F.coalesce("m", "id").alias("component"))


def triangles(graph: Graph) -> DataFrame:
    """triangles: how many there are, edges taken without direction, each once. Edges go from lower to higher degree, so hubs open few pairs."""
    e = graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    deg = e.select("a").unionAll(e.select("b")).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    ranked = e.join(deg.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(deg.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    up = F.struct("da", "a") < F.struct(F.col("db").alias("da"), F.col("b").alias("a"))
    turned = checkpointed(ranked.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("y")))
    wedge = turned.alias("p").join(turned.alias("q"), F.col("p.x") == F.col("q.x")).where("p.y < q.y").select(F.col("p.y").alias("y"), F.col("q.y").alias("z"))
    close = turned.select(F.least("x", "y").alias("y"), F.greatest("x", "y").alias("z"))
    return wedge.join(close, ["y", "z"]).agg(F.count(F.lit(1)).alias("triangles"))


def subgraph(graph: Graph, start: int, max_depth: int = 1) -> Graph:
    """The nodes within some hops of a start, in both directions, and the edges between them."""
    ids = traverse(graph, start, "both", max_depth=max_depth).select(F.col("node_id").alias("id"))
    ids = checkpointed(ids)
    edges = graph.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return Graph(graph.nodes.join(ids, "id", "left_semi"), edges.select(*graph.edges.columns))


def has_edges(graph: Graph, pairs: DataFrame, label: str | None = None) -> DataFrame:
    """pairs (src, dst) with found: whether an edge leads from src to dst."""
    known = graph.steps("out", label).select(F.col("here").alias("src"), F.col("there").alias("dst"), F.lit(True).alias("found")).distinct()
    return pairs.join(known, ["src", "dst"], "left").select(*pairs.columns, F.coalesce("found", F.lit(False)).alias("found"))


def common_neighbours(graph: Graph, a: int, b: int) -> DataFrame:
    """id of the nodes that both a and b point to."""
    out = lambda x: graph.edges.where(F.col("src") == x).select(F.col("dst").alias("id"))
    return out(a).intersect(out(b))


def betweenness(graph: Graph, normalized: bool = True, tasks: int = 16) -> DataFrame:
    """id, score by Brandes' method over directed edges; 0 for all if there are fewer than three nodes.

    The adjacency goes to every task, sources are dealt over tasks. It is meant for graphs whose edges fit one worker
    (``MOST_EDGES``); a larger one is refused.
    """
    nodes = graph.nodes.select("id").distinct()
    n, m = nodes.count(), graph.edges.count()
    if m > MOST_EDGES:
        raise ValueError(f"betweenness takes at most {MOST_EDGES} edges")
    pairs = [(r.src, r.dst) for r in graph.edges.select("src", "dst").collect()]  # at most MOST_EDGES; parallel ones count each
    adjacent: dict[int, list[int]] = {}
    for a, b in pairs:
        adjacent.setdefault(a, []).append(b)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, float] = {}
        for pdf in batches:
            for s in pdf["id"]:
                order, before, paths, far = [], {}, {s: 1.0}, {s: 0}
                queue = [s]
                while queue:
                    ahead = []
                    for v in queue:
                        order.append(v)
                        for w in adjacent.get(v, ()):
                            if w not in far:
                                far[w] = far[v] + 1
                                ahead.append(w)
                            if far[w] == far[v] + 1:
                                paths[w] = paths.get(w, 0.0) + paths[v]
                                before.setdefault(w, []).append(v)
                    queue = ahead
                credit = dict.fromkeys(order, 0.0)
                for w in reversed(order):
                    for v in before.get(w, ()):
                        credit[v] += paths[v] / paths[w] * (1 + credit[w])
                    if w != s:
                        total[w] = total.get(w, 0.0) + credit[w]
        yield pd.DataFrame({"id": list(total), "part": list(total.values())})

    parts = nodes.repartition(tasks, "id").mapInPandas(run, "id long, part double").groupBy("id").agg(F.sum("part").alias("part"))
    scale = 0.0 if n < 3 else 1.0 / ((n - 1) * (n - 2)) if normalized else 1.0
    return nodes.join(parts, "id", "left").select("id", (F.coalesce("part", F.lit(0.0)) * scale).alias("score"))


MOST_EDGES = 2_000_000


def louvain(graph: Graph, passes: int = 15, least_weight: float = 0.001) -> DataFrame:
    """id, community (the least id in it) after one level of local moves, nodes in ascending order, weights below 0.001 as that.

    The moves follow one another, so they run in one task; a graph of more than ``MOST_EDGES`` edges is refused.
    """
    if graph.edges.count() > MOST_EDGES:
        raise ValueError(f"louvain takes at most {MOST_EDGES} edges")
    w = F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(least_weight))
    und = graph.edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    all_nodes = graph.nodes.select("id").distinct()
    rows = und.unionByName(all_nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w"))).withColumn("g", F.lit(0))

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        links: dict[int, dict[int, float]] = {}
        loops: dict[int, float] = {}  # they count in the degree only
        for a, b, x in zip(pdf["a"], pdf["b"], pdf["w"]):
            links.setdefault(a, {})
            links.setdefault(b, {})
            if a != b:
                links[a][b] = links[b][a] = x
            else:
                loops[a] = loops.get(a, 0.0) + x
        home = {v: v for v in links}
        degree = {v: sum(x.values()) + loops.get(v, 0.0) for v, x in links.items()}
        inside = dict(degree)
        twice = sum(degree.values()) or 1.0
        for _ in range(passes):
            moved = False
            for v in sorted(links):
                old = home[v]
                inside[old] -= degree[v]
                near: dict[int, float] = {}
                for u, x in links[v].items():
                    near[home[u]] = near.get(home[u], 0.0) + x
                gain = lambda c: near.get(c, 0.0) - inside[c] * degree[v] / twice  # noqa: B023, E731
                best = min([old, *near], key=lambda c: (-round(gain(c), 12), c != old, c))
                home[v] = best
                inside[best] += degree[v]
                moved |= best != old
            if not moved:
                break
        least: dict[int, int] = {}
        for v, c in home.items():
            least[c] = min(least.get(c, v), v)
        return pd.DataFrame({"id": list(home), "community": [least[c] for c in home.values()]})

    return rows.groupBy("g").applyInPandas(move, "id long, community long")
