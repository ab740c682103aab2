"""Order of patches by their references: adjacency, strongly connected groups, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import cut_lineage


def node_name() -> Column:
    return F.concat_ws("/", "resource_type", "resource_id")


def insert_adjacency(patches: DataFrame, references: DataFrame) -> DataFrame:
    """``(src, dst)``: a patch refers to a resource that another patch of the batch creates; deletions refer to none.

    ``references`` has ``(resource_type, resource_id, value)``.
    """
    nodes = patches.where(F.col("type") == "INSERT").select(node_name().alias("dst"))
    alive = patches.where(F.col("type") != "DELETE").select("resource_type", "resource_id")
    out = references.join(alive, ["resource_type", "resource_id"], "left_semi").select(node_name().alias("src"), F.col("value").alias("dst"))
    return out.join(nodes, "dst", "left_semi").select("src", "dst").distinct()


def _least_reaching(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, color)``: the least node from which each node can be reached. Colours only fall, so it ends."""
    color = nodes.select("node", F.col("node").alias("color"))
    while True:
        pushed = edges.join(color.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("pushed"))
        step = color.join(pushed, "node", "left").select("node", F.least("color", F.coalesce("pushed", "color")).alias("color"), (F.col("pushed") < F.col("color")).alias("moved"))
        step = cut_lineage(step)
        color = step.select("node", "color")
        if step.where("moved").isEmpty():
            return color


def _without(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges between nodes that are not ``gone(node)``."""
    out = edges.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti")
    return cut_lineage(out.select("src", "dst"))


def _union(parts: list[DataFrame], empty: DataFrame) -> DataFrame:
    out = parts[0] if parts else empty
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def strongly_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``: nodes that reach each other share the least of their names.

    Nodes that no edge leads to, or none leaves, are components of their own
    and are trimmed first. Then forward colours, and backward reachability
    inside a colour; what is not settled goes into the next pass. Each pass
    settles a node at least, so no number of passes is set. All of it is joins;
    each step is cut.
    """
    left = cut_lineage(nodes.select("node").distinct())
    edges = edges.where("src <> dst").join(left.withColumnRenamed("node", "src"), "src", "left_semi").join(left.withColumnRenamed("node", "dst"), "dst", "left_semi")
    edges = cut_lineage(edges.select("src", "dst").distinct())
    done: list[DataFrame] = []
    while not left.isEmpty():
        inner = edges.select(F.col("src").alias("node")).intersect(edges.select(F.col("dst").alias("node")))
        alone = cut_lineage(left.join(inner, "node", "left_anti"))
        if not alone.isEmpty():
            done.append(alone.select("node", F.col("node").alias("component")))
            left, edges = cut_lineage(left.join(alone, "node", "left_anti")), _without(edges, alone)
            continue
        color = _least_reaching(left, edges)
        near = edges.join(color.select(F.col("node").alias("src"), F.col("color").alias("c")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("c")), ["dst", "c"])
        near = cut_lineage(near.select("src", "dst"))
        found = cut_lineage(color.where("node = color"))
        fresh = found
        while not fresh.isEmpty():
            more = near.join(fresh.withColumnRenamed("node", "dst"), "dst").select(F.col("src").alias("node"), "color").distinct()
            fresh = cut_lineage(more.join(found, "node", "left_anti"))
            found = cut_lineage(found.unionByName(fresh))
        done.append(found.select("node", F.col("color").alias("component")))
        left, edges = cut_lineage(left.join(found, "node", "left_anti")), _without(edges, found)
    return _union(done, nodes.select("node", F.col("node").alias("component")))


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, level)`` of an acyclic graph: 0 without references, else one above the highest node referred to."""
    left = cut_lineage(nodes.select("node").distinct())
    edges = cut_lineage(edges.where("src <> dst").select("src", "dst").distinct())
    done: list[DataFrame] = []
    while not left.isEmpty():
        waiting = edges.join(left.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
        ready = cut_lineage(left.join(waiting, "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the graph has a cycle")
        done.append(ready.select("node", F.lit(len(done)).cast("long").alias("level")))
        left = cut_lineage(left.join(ready, "node", "left_anti"))
    return _union(done, nodes.select("node", F.lit(0).cast("long").alias("level")))


def ordered_groups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component, level)``: groups of patches, those referred to at lower levels than those that refer."""
    groups = cut_lineage(strongly_connected(nodes, edges))
    a, b = (groups.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("src", "a"), ("dst", "b")))
    between = edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    high = levels(groups.select(F.col("component").alias("node")), between)
    return groups.join(high.withColumnRenamed("node", "component"), "component").select("node", "component", "level")
