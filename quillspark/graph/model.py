"""Graphs, their projection from tables, neighbours, and pattern matching."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.lite import json_path

DIRECTIONS = ("out", "in", "both")


@dataclass(frozen=True)
class Graph:
    """nodes: id long, label string, properties string (JSON). edges: src, dst long, label string, weight double, properties string."""

    nodes: DataFrame
    edges: DataFrame

    def steps(self, direction: str = "out", label: str | None = None) -> DataFrame:
        """here, there, label, weight: the edges as moves in a direction; labels match in any case, null ones never."""
        if direction not in DIRECTIONS:
            raise ValueError(f"direction must be one of {DIRECTIONS}")
        e = self.edges if label is None else self.edges.where(F.lower("label") == label.lower())
        out = e.select(F.col("src").alias("here"), F.col("dst").alias("there"), "label", "weight")
        back = e.select(F.col("dst").alias("here"), F.col("src").alias("there"), "label", "weight")
        return out if direction == "out" else back if direction == "in" else out.unionAll(back)

    def neighbours(self, ids: DataFrame, direction: str = "out", label: str | None = None) -> DataFrame:
        """id, neighbour, label, weight for the ids given as a table with a column id."""
        return ids.select(F.col("id").alias("here")).join(self.steps(direction, label), "here").select(F.col("here").alias("id"), F.col("there").alias("neighbour"), "label", "weight")

    def degree(self, direction: str = "out") -> DataFrame:
        """id, degree of every node, 0 included; parallel edges count each."""
        d = self.steps(direction).groupBy(F.col("here").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
        return self.nodes.select("id").join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))

    def without_nodes(self, ids: DataFrame) -> Graph:
        """Without the nodes of ids (column id) and their edges."""
        gone = ids.select("id")
        edges = self.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
        return Graph(self.nodes.join(gone, "id", "left_anti"), edges.select(*self.edges.columns))

    def without_edges(self, ends: DataFrame, label: str | None = None) -> Graph:
        """Without the edges between the ends given (src, dst), of a label if named."""
        gone = ends.select("src", "dst").distinct()
        if label is None:
            return Graph(self.nodes, self.edges.join(gone, ["src", "dst"], "left_anti").select(*self.edges.columns))
        return Graph(self.nodes, self.edges.join(gone.withColumn("_l", F.lit(label.lower())), (self.edges["src"] == gone["src"]) & (self.edges["dst"] == gone["dst"]) & (F.lower(self.edges["label"]) == F.col("_l")), "left_anti"))

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return Graph(self.nodes.unionByName(nodes), self.edges)

    def with_edges(self, edges: DataFrame) -> Graph:
        return Graph(self.nodes, self.edges.unionByName(edges))


def node_id(col: Column | str) -> Column:
    """A key as a node id: integers as they are, other texts hashed."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.cast("string").try_cast("bigint"), F.xxhash64(c.cast("string")))


def nodes_from(df: DataFrame, key: Column | str, label: str, properties: list[str] | None = None) -> DataFrame:
    """Nodes of a table's rows; properties become a JSON object."""
    props = F.to_json(F.struct(*(properties or []))) if properties else F.lit("{}")
    return df.select(node_id(key).alias("id"), F.lit(label).alias("label"), props.alias("properties"))


def edges_from(df: DataFrame, src: Column | str, dst: Column | str, label: str, weight: Column | None = None, properties: list[str] | None = None) -> DataFrame:
    """Edges of a table's rows; those without one end are left out."""
    props = F.to_json(F.struct(*(properties or []))) if properties else F.lit("{}")
    e = df.select(node_id(src).alias("src"), node_id(dst).alias("dst"), F.lit(label).alias("label"), (weight if weight is not None else F.lit(1.0)).cast("double").alias("weight"), props.alias("properties"))
    return e.where("src is not null and dst is not null")


def value(var: str, key: str) -> Column:
    """A variable's id, label or weight, or a JSON property, as text."""
    if key in ("id", "label", "weight"):
        return F.col(f"{var}.{key}")
    return F.get_json_object(F.col(f"{var}.properties"), json_path(key))


def match(graph: Graph, a: str = "a", r: str = "r", b: str = "b", a_label: str | None = None, r_label: str | None = None, b_label: str | None = None, hops: tuple[int, int] = (1, 1), direction: str = "out", where_a: Column | None = None) -> DataFrame:
    """Struct columns a, r and b of each match of (a:A)-[r:R*min..max]->(b:B).

    where_a is a condition on a that holds before the walk begins. One hop gives each edge once; several give each pair of ends once, with r holding the number of hops as weight.
    """
    has = lambda df, label: df if label is None else df.where(F.lower("label") == label.lower())
    left = has(graph.nodes, a_label).select(F.struct("id", "label", "properties").alias(a))
    left = left if where_a is None else left.where(where_a)
    right = has(graph.nodes, b_label).select(F.struct("id", "label", "properties").alias(b))
    if hops == (1, 1):
        e = has(graph.edges, r_label)
        whole = F.struct("label", "weight", "properties").alias(r)
        moves = e.select(F.col("src").alias("_x"), F.col("dst").alias("_y"), whole)
        back = e.select(F.col("dst").alias("_x"), F.col("src").alias("_y"), whole)
        moves = moves if direction == "out" else back if direction == "in" else moves.unionAll(back)
    else:
        moves = expand(graph, direction, r_label, *hops, starts=None if a_label is None and where_a is None else left.select(F.col(f"{a}.id").alias("id"))).select(F.col("here").alias("_x"), F.col("there").alias("_y"), F.struct(F.lit(r_label).alias("label"), F.col("hops").cast("double").alias("weight"), F.lit("{}").alias("properties")).alias(r))
    return moves.join(left, F.col("_x") == F.col(f"{a}.id")).join(right, F.col("_y") == F.col(f"{b}.id")).select(a, r, b)


def expand(graph: Graph, direction: str, label: str | None, least: int, most: int, starts: DataFrame | None = None) -> DataFrame:
    """here, there, hops: the pairs of nodes joined by least to most hops, each once with its fewest hops in that range. starts: the nodes (id) to walk from, all if None."""
    if not 0 < least <= most:
        raise ValueError("hops must be at least 1 and in order")
    step = graph.steps(direction, label).select("here", "there").distinct()
    first = step if starts is None else step.join(starts.select(F.col("id").alias("here")), "here", "left_semi")
    walk, found = first.select("here", "there").withColumn("hops", F.lit(1)), None
    for n in range(1, most + 1):
        if n > 1:
            walk = walk.select("here", F.col("there").alias("mid")).join(step.withColumnRenamed("here", "mid"), "mid").select("here", "there").distinct().withColumn("hops", F.lit(n))
        if n >= least:
            found = walk if found is None else found.unionAll(walk)
    return found.groupBy("here", "there").agg(F.min("hops").alias("hops"))
