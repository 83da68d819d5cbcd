"""Similarity graphs: edges, neighbours, paths, components, lineage, entities. Edges are (src, dst) pairs of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirmill.operators.components import linked_classes
from weirmill.session import stored

#: Longest lineage that is followed.
MAX_LINEAGE = 65


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def edges_with_nodes(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges both of whose ends are nodes."""
    return edges.join(nodes.select(F.col(key).alias("src")), "src", "left_semi").join(nodes.select(F.col(key).alias("dst")), "dst", "left_semi")


def missing_nodes(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Ends of edges that are no node yet, for which stubs are made."""
    ends = edges.select(F.col("src").alias(key)).unionByName(edges.select(F.col("dst").alias(key))).distinct()
    return ends.join(nodes.select(key), key, "left_anti")


def neighbours(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth): nodes within ``depth`` hops of each start (column ``start``), itself excluded, at their least depth."""
    links = stored(both_ways(edges), "links")
    seen = starts.select("start", F.col("start").alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for d in range(1, depth + 1):
        step = front.join(links, front["node"] == links["src"]).select("start", F.col("dst").alias("node")).distinct()
        front = stored(step.join(seen, ["start", "node"], "left_anti").withColumn("depth", F.lit(d)), "front")
        seen = seen.unionByName(front)
    return seen.filter("depth > 0")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_nodes: int) -> DataFrame:
    """(source, target, path): a shortest path of at most ``max_nodes`` nodes, the smallest by its nodes in order; a node's path
    to itself is itself, even if it has no edge. Pairs without a path are left out."""
    links = stored(both_ways(edges), "links")
    trivial = pairs.filter("source = target").select("source", "target", F.array("source").alias("path"))
    goals = pairs.filter("source <> target").distinct()
    front = goals.select("source", "target", F.array("source").alias("path"), F.col("source").alias("at"))
    found = trivial
    for _ in range(max_nodes - 1):
        step = front.join(links, front["at"] == links["src"]).filter(~F.array_contains("path", F.col("dst")))
        step = step.select("source", "target", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("at"))
        # one path a reached node: the smallest of the shortest is enough to extend
        step = stored(step.groupBy("source", "target", "at").agg(F.min("path").alias("path")), "front")
        hits = step.filter("at = target").select("source", "target", "path")
        found = found.unionByName(hits)
        front = step.join(hits.select("source", "target"), ["source", "target"], "left_anti").select("source", "target", "path", "at")
    return found


def cytoscape(nodes: DataFrame, key: str, properties: list[str], edges: DataFrame) -> DataFrame:
    """(kind, element): the graph's elements as JSON objects, one a row, so that a graph of any size can be written as lines."""
    node = F.to_json(F.struct(F.struct(F.col(key).alias("id"), *properties).alias("data")))
    edge = F.to_json(F.struct(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), "label").alias("data")))
    return nodes.select(F.lit("node").alias("kind"), node.alias("element")).unionByName(edges.select(F.lit("edge").alias("kind"), edge.alias("element")))


def read_pattern(pattern: str) -> str:
    """Which scan a graph pattern asks for: ``edges`` with an arrow, else ``nodes``; other text is an error."""
    if not pattern.strip().upper().startswith("MATCH") or "RETURN" not in pattern.upper():
        raise ValueError(f"unsupported pattern {pattern!r}")
    return "edges" if "->" in pattern else "nodes"


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node of each connected component with two nodes or more."""
    return linked_classes(edges).withColumnRenamed("label", "component")


def lineage(nodes: DataFrame, key: str, parent: str, starts: DataFrame, most: int = MAX_LINEAGE) -> DataFrame:
    """(start, depth, node, found): each start and its ancestors; a missing parent ends the chain with found = false.

    At most ``most`` entries a start, so a cycle ends. Unknown starts are left out.
    """
    links = nodes.select(F.col(key).alias("id"), F.col(parent).alias("up")).dropDuplicates(["id"])
    at = starts.select(F.col("start"), F.col("start").alias("node")).join(links, F.col("node") == F.col("id")).select("start", F.lit(0).alias("depth"), "node", F.lit(True).alias("found"), "up")
    out = front = stored(at, "lineage")
    for d in range(1, most):
        front = front.filter("up is not null").select("start", F.col("up").alias("node")).join(links, F.col("node") == F.col("id"), "left")
        front = stored(front.select("start", F.lit(d).alias("depth"), "node", F.col("id").isNotNull().alias("found"), "up"), "lineage")
        if front.isEmpty():
            break
        out = out.unionByName(front)
    return out.drop("up")


def lineage_depths(nodes: DataFrame, key: str, parent: str, order: str) -> DataFrame:
    """(key, depth) on insertion in order: 0 without parent, the parent's depth + 1 if it came before, 1 if it is unknown.

    Chains may be of any depth: a parent came before its child, so each round places rows until none are left.
    """
    rows = nodes.select(F.col(key).alias("id"), F.col(parent).alias("up"), F.col(order).alias("at"))
    before = rows.select(F.col("id").alias("up"), F.col("at").alias("up_at"), F.lit(True).alias("known"))
    linked = rows.join(before, "up", "left").withColumn("root", F.when(F.col("up").isNull(), F.lit(0)).when(F.col("known") & (F.col("up_at") < F.col("at")), None).otherwise(1))
    done = stored(linked.filter("root is not null").select("id", F.col("root").alias("depth")), "depths")
    left = stored(linked.filter("root is null").select("id", "up"), "depths")
    out = done
    while not left.isEmpty():
        done = stored(left.join(done.select(F.col("id").alias("up"), "depth"), "up").select("id", (F.col("depth") + 1).alias("depth")), "depths")
        if done.isEmpty():
            raise RuntimeError("rows whose parents are never placed")
        left = stored(left.join(done.select("id"), "id", "left_anti"), "depths")
        out = out.unionByName(done)
    return out


def entities(text: Column) -> Column:
    """Distinct runs of capitalised words."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?U)\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b"), 0))
