"""A subset of the Cypher language over Graph: one pattern, WHERE with AND, RETURN, count(*), LIMIT."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.graph import model

_NODE = r"\(\s*(?P<{0}>\w+)?\s*(?::\s*(?P<{0}l>\w+))?\s*\)"
_PATTERN = re.compile(
    r"\s*MATCH\s*" + _NODE.format("a") + r"\s*(?P<left><)?-\s*(?:\[\s*(?P<r>\w+)?\s*(?::\s*(?P<rl>\w+))?\s*(?:\*\s*(?P<lo>\d+)?\s*(?P<dots>\.\.)?\s*(?P<hi>\d+)?)?(?P<star>)\s*\])?\s*-(?P<right>>)?\s*"
    + _NODE.format("b") + r"\s*(?:WHERE\s+(?P<where>.+?)\s+)?RETURN\s+(?P<ret>.+?)(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$",
    re.I | re.S,
)
_TEST = re.compile(r"\s*(\w+)\.(\w+(?:\.\w+)*)\s*(=|<>|!=|<=|>=|<|>|CONTAINS)\s*('(?:[^']|'')*'|\"[^\"]*\"|-?\d+(?:\.\d+)?)\s*$", re.I)
#: Longest way of a pattern whose end is left open (``*`` or ``*2..``), at least its least one; set it higher to walk on.
OPEN_END = 1


def _test(text: str, kinds: dict[str, str]) -> Column:
    m = _TEST.match(text)
    if not m or m[1] not in kinds:
        raise ValueError(f"condition not understood: {text}")
    left, op, raw = model.value(m[1], m[2]), m[3].upper(), m[4]
    if raw[0] in "'\"":
        right, left = F.lit(raw[1:-1].replace("''", "'")), left.cast("string")
    else:
        right, left = F.lit(float(raw)), left.try_cast("double")
    return {"=": left == right, "<>": left != right, "!=": left != right, "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right, "CONTAINS": left.contains(right)}[op]


def run(graph: model.Graph, query: str) -> DataFrame:
    """The rows of a query. A bare variable is returned as its struct; count(*) groups by the other items."""
    m = _PATTERN.match(query)
    if not m:
        raise ValueError(f"query not understood: {query}")
    a, b, r = m["a"] or "_a", m["b"] or "_b", m["r"] or "_r"
    many = re.search(r"\[[^\]]*\*", query.split("RETURN")[0]) is not None
    lo = int(m["lo"]) if m["lo"] else 1
    hi = int(m["hi"]) if m["hi"] else (max(lo, OPEN_END) if m["dots"] or not m["lo"] else lo)
    direction = "in" if m["left"] else "out" if m["right"] else "both"
    kinds = {a: "node", b: "node", r: "edge"}
    parts = re.split(r"\s+AND\s+", m["where"], flags=re.I) if m["where"] else []
    start = None  # what the first node must be holds before the walk begins
    for part in (p for p in parts if re.match(rf"\s*{a}\.", p)):
        start = _test(part, kinds) if start is None else start & _test(part, kinds)
    rows = model.match(graph, a, r, b, m["al"], m["rl"], m["bl"], (lo, hi) if many else (1, 1), direction, start)
    for part in parts:
        rows = rows.where(_test(part, kinds))
    items, counted = [], None
    for item in (x.strip() for x in m["ret"].split(",")):
        expr, _, alias = re.match(r"(.+?)(\s+AS\s+(\w+))?$", item, re.I | re.S).groups()
        if re.fullmatch(r"count\s*\(\s*(\*|\w+)\s*\)", expr, re.I):
            counted = alias or "count"
        elif "." in expr:
            var, key = expr.split(".", 1)
            items.append(model.value(var, key).alias(alias or expr.replace(".", "_")))
        elif expr in kinds:
            items.append(F.col(expr).alias(alias or expr))
        else:
            raise ValueError(f"item not understood: {item}")
    if counted:
        out = rows.select(*items).groupBy(*rows.select(*items).columns).agg(F.count(F.lit(1)).alias(counted)) if items else rows.agg(F.count(F.lit(1)).alias(counted))
    else:
        out = rows.select(*items)
    return out.limit(int(m["limit"])) if m["limit"] else out


_CREATE_EDGE = re.compile(r"\s*CREATE\s*\(\s*(\d+)\s*\)\s*-\s*\[\s*:\s*(\w+)\s*(?:\{\s*weight\s*:\s*([\d.]+)\s*\})?\s*\]\s*->\s*\(\s*(\d+)\s*\)\s*;?\s*$", re.I)
_CREATE_NODE = re.compile(r"\s*CREATE\s*\(\s*(?:\w+)?\s*:\s*(\w+)\s*(\{.*\})?\s*\)\s*;?\s*$", re.I | re.S)


def create(graph: model.Graph, statement: str) -> model.Graph:
    """The graph with one more edge, CREATE (1)-[:L {weight: 2}]->(2), or node, CREATE (:L {json}), under the next free id."""
    spark = graph.nodes.sparkSession
    if m := _CREATE_EDGE.match(statement):
        row = (int(m[1]), int(m[4]), m[2], float(m[3] or 1.0), "{}")
        return graph.with_edges(spark.createDataFrame([row], "src long, dst long, label string, weight double, properties string"))
    if m := _CREATE_NODE.match(statement):
        props = re.sub(r"([{,]\s*)(\w+)\s*:", r'\1"\2":', (m[2] or "{}").replace("'", '"'))
        top = graph.nodes.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        return graph.with_nodes(spark.createDataFrame([(top + 1, m[1], props)], "id long, label string, properties string"))
    raise ValueError(f"statement not understood: {statement}")
