"""Graphs as node and edge tables: degrees, bounded search, layers, closure, path trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import names
from fieldloom.operators.components import connected_components
from fieldloom.plans.scratch import Scratch


def degree_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: node_count, edge_count, isolated, max_out, max_in, avg_out of nodes (n) and edges (src, dst)."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        e.select(F.col("dst").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i"))
    )
    deg = nodes.select("n").join(ends.groupBy("n").agg(F.sum("o").alias("o"), F.sum("i").alias("i")), "n", "left").fillna(0)
    return deg.agg(
        F.count("*").alias("node_count"),
        F.sum("o").alias("edge_count"),
        F.count_if((F.col("o") == 0) & (F.col("i") == 0)).alias("isolated"),
        F.max("o").alias("max_out"),
        F.max("i").alias("max_in"),
        F.round(F.avg("o"), 2).alias("avg_out"),
    )


def reachable(edges: DataFrame, start: DataFrame, max_depth: int | None = None, rounds: int = 200) -> DataFrame:
    """``(n, depth)`` of nodes reached from ``start`` (n), which itself is left out.

    A frontier a round; visited nodes are written to the shared folder, which
    cuts lineage.  Nodes deeper than ``rounds`` without a ``max_depth`` raise.
    """
    scratch = Scratch(edges.sparkSession)
    e = scratch.keep(edges.select("src", "dst").distinct(), "bfs-edges")
    seen = scratch.keep(start.select("n", F.lit(0).alias("depth")).distinct(), "bfs-0")
    frontier = seen
    for depth in range(1, (max_depth or rounds) + 1):
        step = frontier.join(e, frontier["n"] == e["src"]).select(F.col("dst").alias("n")).distinct()
        frontier = scratch.keep(step.join(seen, "n", "left_anti").withColumn("depth", F.lit(depth)), f"bfs-{depth}")
        if frontier.isEmpty():
            break
        seen = scratch.keep(seen.union(frontier), "bfs-seen")
    else:
        if max_depth is None:
            raise RuntimeError(f"nodes lie deeper than {rounds} rounds")
    return seen.where("depth > 0")


def components_with_isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(n, comp)`` for every node (n), alone or not; comp is the smallest node."""
    comps = connected_components(edges, "src", "dst")
    return (
        nodes.select("n")
        .join(comps.withColumnRenamed("node", "n"), "n", "left")
        .select("n", F.coalesce("component", "n").alias("comp"))
    )


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("comp").agg(F.count("*").alias("size"))


def roots(edges: DataFrame) -> DataFrame:
    """Nodes (n) that call and are never called."""
    return edges.select(F.col("src").alias("n")).distinct().join(edges.select(F.col("dst").alias("n")), "n", "left_anti")


def layers(nodes: DataFrame, edges: DataFrame, rounds: int = 500) -> DataFrame:
    """``(n, layer)``: nodes (n) peeled when everything they need (src needs dst) is; null in a cycle.

    More than ``rounds`` layers raise.
    """
    scratch = Scratch(nodes.sparkSession)
    left = scratch.keep(nodes.select("n").distinct(), "peel-nodes")
    needs = scratch.keep(edges.select("src", "dst").distinct(), "peel-edges")
    done = None
    for layer in range(rounds):
        open_needs = needs.join(left.withColumnRenamed("n", "dst"), "dst", "left_semi")
        free = scratch.keep(left.join(open_needs.select(F.col("src").alias("n")), "n", "left_anti"), "peel-free")
        if free.isEmpty():
            break
        now = free.withColumn("layer", F.lit(layer))
        done = scratch.keep(now if done is None else done.union(now), "peel-done")
        left = scratch.keep(left.join(free, "n", "left_anti"), "peel-left")
    else:
        raise RuntimeError(f"more than {rounds} layers")
    rest = left.withColumn("layer", F.lit(None).cast("int"))
    return rest if done is None else done.union(rest)


def path_tree(paths: DataFrame, separator: str = ".") -> DataFrame:
    """``(prefix, depth, leaves)``: the prefix tree of dotted paths with leaf counts."""
    cut = paths.select(F.posexplode(names.ancestors(F.col("path"), separator)).alias("depth", "prefix"))
    return cut.groupBy("prefix", "depth").agg(F.count("*").alias("leaves"))
