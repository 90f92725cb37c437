"""Connected components of a graph given as links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoloom.llm.common import Workspace

#: Far more than any graph needs: rounds grow with the logarithm of its size.
MOST_ROUNDS = 200


def components(links: DataFrame, space: Workspace) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b); root is the component's least node.

    Alternating large-star and small-star steps: each step keeps components and
    never adds edges, and ends when every node points at its component's least
    node. A node with very many neighbours costs one row per neighbour, and its
    minimum is pre-aggregated before the shuffle. Each round is written to the
    shared folder. No links give no rows. Steps that don't end raise an error.
    """
    edges = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = space.put(edges, "edges-0")
    mark = None
    for turn in range(1, MOST_ROUNDS):
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not now.n or mark == now:
            break
        mark = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = space.put(large, f"large-{turn}")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = space.put(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), f"edges-{turn}")
        space.drop(f"large-{turn}")
        space.drop(f"edges-{turn - 1}")
    else:
        raise RuntimeError(f"components didn't settle in {MOST_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
