"""Chained hops from a set of nodes, one join a hop."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.lite import json_path, tokens_of
from quillspark.graph.model import Graph
from quillspark.operators import retrieval, vectors


class Chain:
    """Immutable: each method gives a new chain. Filters apply to the nodes reached last; parallel ways count once."""

    def __init__(self, graph: Graph, ids: DataFrame) -> None:
        self.graph, self.here = graph, ids.select("id").distinct()

    def _hop(self, direction: str, label: str | None, min_weight: float | None) -> Chain:
        steps = self.graph.steps(direction, label)
        if min_weight is not None:
            steps = steps.where(F.col("weight") >= min_weight)
        return Chain(self.graph, self.here.withColumnRenamed("id", "here").join(steps, "here").select(F.col("there").alias("id")))

    def out(self, label: str | None = None, min_weight: float | None = None) -> Chain:
        return self._hop("out", label, min_weight)

    def in_(self, label: str | None = None, min_weight: float | None = None) -> Chain:
        return self._hop("in", label, min_weight)

    def both(self, label: str | None = None, min_weight: float | None = None) -> Chain:
        return self._hop("both", label, min_weight)

    def nodes(self) -> DataFrame:
        return self.graph.nodes.join(self.here, "id", "left_semi")

    def filter_label(self, label: str) -> Chain:
        return Chain(self.graph, self.nodes().where(F.lower("label") == label.lower()))

    def filter_property(self, key: str, wanted: str) -> Chain:
        return Chain(self.graph, self.nodes().where(F.get_json_object("properties", json_path(key)) == wanted))

    def matches(self) -> DataFrame:
        """The reached nodes with score 1."""
        return self.nodes().withColumn("score", F.lit(1.0))

    def ids(self) -> DataFrame:
        return self.here

    def vector_near(self, query: list[float], k: int, vector: str = "vector") -> DataFrame:
        """The k reached nodes nearest to the query by cosine; the node table needs a vector column."""
        return vectors.nearest(self.nodes(), vector, query, k, "id")

    def bm25_search(self, query: str, k: int, text: str = "properties") -> DataFrame:
        """The k reached nodes with the best BM25 score among themselves, score mapped to 0..1 by x / (x + 1)."""
        found = retrieval.bm25(self.nodes().select("id", text), "id", text, query, k, least_idf=0.0, repeats=True)
        return found.select("id", (F.col("score") / (F.col("score") + 1)).alias("score"))

    def hybrid_rank(self, query: str, vector_query: list[float], k: int, vector_weight: float = 0.5, text: str = "properties", vector: str = "vector") -> DataFrame:
        """id, score: vector_weight times the cosine (0 if negative) plus the rest times the mapped BM25 score; ties by id."""
        words = self.bm25_search(query, 1 << 30, text).withColumnRenamed("score", "words")
        near = self.nodes().select("id", F.greatest(F.lit(0.0), 1 - vectors.cosine_distance(F.col(vector), F.array(*(F.lit(float(x)) for x in vector_query)))).alias("near"))
        score = vector_weight * F.coalesce("near", F.lit(0.0)) + (1 - vector_weight) * F.coalesce("words", F.lit(0.0))
        return near.join(words, "id", "left").select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _depth(k: int, weights: tuple[float, ...], limit: int) -> int:
    """Ranks up to which a list matters for the best limit: from there on, all weights together are worth less than the least weight at rank limit."""
    return max(limit, math.ceil(sum(weights) / min(w for w in weights if w > 0) * (k + limit) - k) + 1)


def allowed(graph: Graph, tenant: str | None = None, roles: list[str] | None = None, metadata: dict[str, str] | None = None) -> Graph:
    """The graph of the nodes that a caller may see."""
    at = lambda key: F.get_json_object("properties", json_path(key))
    nodes = graph.nodes
    if tenant is not None:
        nodes = nodes.where(at("tenant") == tenant)
    if roles is not None:
        nodes = nodes.where(at("role").isNull() | at("role").isin(roles))
    for key, wanted in (metadata or {}).items():
        nodes = nodes.where(at(key) == wanted)
    return Graph(nodes, graph.edges)


def markdown(found: DataFrame, graph: Graph, query: str, title: str = "name") -> str:
    """The nodes of a graph_rag result as Markdown, best first; there are no more than its limit."""
    rows = found.join(graph.nodes.select("id", "label", "properties"), "id").orderBy(F.desc("score"), "id").collect()
    out = [f"# {query}", ""]
    for r in rows:
        props = json.loads(r.properties or "{}")
        out += [f"## {props.get(title, r.id)} ({r.label})", "", f"- distance: {r.depth}", f"- score: {r.score:.4f}", *(f"- {k}: {v}" for k, v in props.items() if k != title), ""]
    return "\n".join(out)


def lexical_share(text: str, query: str):
    """Share of the query's tokens that stand in a text."""
    terms = tokens_of(F.lit(query))
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(F.col(text)), t))) / F.greatest(F.size(terms), F.lit(1))


def graph_rag(graph: Graph, seeds: DataFrame, query: str, hops: int = 2, k: int = 60, weights: tuple[float, float, float] = (0.5, 0.3, 0.2), limit: int = 5, text: str = "properties", tenant: str | None = None, roles: list[str] | None = None, metadata: dict[str, str] | None = None) -> DataFrame:
    """id, depth, score, lexical: nodes around the seeds (id, score) ranked by three fused lists.

    tenant, roles (a node's role must be one of them; a node without one is open to all) and metadata restrict the nodes
    that are seen, on the way too; they are compared with the properties of those names.

    The lists are the seeds' own scores, nearness in hops, and the share of the query's tokens in the node's text.
    """
    from quillspark.session import checkpointed

    graph = allowed(graph, tenant, roles, metadata)
    seeds = seeds.join(graph.nodes.select("id"), "id", "left_semi")
    seen = checkpointed(seeds.select("id", F.lit(0).alias("depth")).distinct())
    edge = seen
    steps = graph.steps("both").select("here", "there").join(graph.nodes.select(F.col("id").alias("there")), "there", "left_semi")
    for depth in range(1, hops + 1):
        new = edge.withColumnRenamed("id", "here").join(steps, "here").select(F.col("there").alias("id")).distinct().join(seen, "id", "left_anti").withColumn("depth", F.lit(depth))
        edge = checkpointed(new)
        seen = seen.unionAll(edge)
    around = checkpointed(seen.join(graph.nodes, "id").select("id", "depth", lexical_share(text, query).alias("lexical")).join(seeds.select("id", F.col("score").alias("seed")), "id", "left"))
    lists = [(around.where("seed is not null"), "seed", weights[0]), (around.withColumn("near", -F.col("depth")), "near", weights[1]), (around.where("lexical > 0"), "lexical", weights[2])]
    # A node can't be among the best limit with ranks over this depth in every list, since others would be before it in each.
    lists = [(df.orderBy(F.desc(c), "id").limit(_depth(k, weights, limit)), c, w) for df, c, w in lists]
    return retrieval.fuse(lists, "id", k).join(around.select("id", "depth", "lexical"), "id").select("id", "depth", "score", "lexical").orderBy(F.desc("score"), "id").limit(limit)
