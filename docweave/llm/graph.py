"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import discard, materialize


def _stars(near: DataFrame) -> DataFrame:
    """(u, v, m): each pair of ``near`` (u, v) with the least of u and all its v."""
    least = near.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return near.join(least, "u")


def connected_components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b), of any sortable type: root is the least node of its component.

    Each round is two joins of the edges with a minimum per node, written to
    the shared folder; their number grows with the logarithm of the nodes. It
    raises if ``rounds`` aren't enough. Nodes only in loops keep themselves.
    """
    now = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _stars(down)
        merged = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, materialize(merged, "edges")
        discard(last)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if state == before:
            roots = now.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
            return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
        before = state
    raise RuntimeError(f"components not settled after {rounds} rounds")
