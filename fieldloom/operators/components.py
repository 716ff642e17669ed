"""Connected components by alternating large-star and small-star rounds.

Both stars replace a node's links by links to the smallest node it knows; the
number of rounds grows with the logarithm of a component's size, and every
round is a partial aggregation plus one join whose two sides are plain tables,
so a node with very many links is split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from fieldloom.plans.scratch import Scratch


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of an undirected edge table.

    component is the smallest node of the component.  Null ends and self-links
    are ignored, repeated links count once, an empty table gives an empty
    result; nodes without a link to another node have no row.
    """
    scratch = Scratch(edges.sparkSession)
    x, y = edges[a], edges[b]
    first = edges.select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo"))
    cur = scratch.keep(first.where(x.isNotNull() & y.isNotNull() & (x != y)).distinct(), "links")
    for _ in range(max_rounds):
        both = cur.select(F.col("hi").alias("n"), F.col("lo").alias("o")).union(
            cur.select(F.col("lo").alias("n"), F.col("hi").alias("o"))
        )
        # settled when each node with a smaller neighbour has no other one
        seen = Observation()
        unsettled = F.count(F.when((F.col("m") < F.col("n")) & (F.col("degree") > 1), 1)).alias("nodes")
        least = both.groupBy("n").agg(F.min("o").alias("m"), F.count("*").alias("degree")).observe(seen, unsettled)
        low = scratch.keep(least.select("n", F.least("n", "m").alias("m")), "low")
        if not seen.get["nodes"]:
            scratch.drop(cur)
            return low.select(F.col("n").alias("node"), F.col("m").alias("component"))
        # large star: a node's larger neighbours move to its smallest neighbour
        moved = both.where("o > n").join(low, "n").select(F.col("o").alias("hi"), F.col("m").alias("lo"))
        large = scratch.keep(moved, "large")
        # small star: a node and its smaller neighbours move to the smallest of them
        low2 = scratch.keep(large.groupBy("hi").agg(F.min("lo").alias("m")), "low2")
        joined = large.join(low2, "hi")
        nxt = scratch.keep(
            joined.select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
            .where("hi <> lo")
            .union(low2.select("hi", F.col("m").alias("lo")))
            .distinct(),
            "links",
        )
        scratch.drop(cur, low, large, low2)
        cur = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
