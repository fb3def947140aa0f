"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.session import cut_lineage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every node of ``edges`` with the smallest node of its component.

    Returns ``(node, component)``. Each round hooks labels along edges (a map-side
    combinable ``min``, so a hub never gathers its neighbours in one task) and then
    halves label chains by pointer jumping, so the rounds grow with the logarithm of
    the diameter. Edges with a null end are ignored; self loops keep a node as its own
    component; an empty input gives an empty result. Raises if it has not converged
    after ``max_rounds``.
    """
    pairs = (
        edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
        .where("a is not null and b is not null")
        .distinct()
    )
    both = cut_lineage(pairs.union(pairs.select("b", "a")).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    for _ in range(max_rounds):
        near = (
            both.join(labels.withColumnRenamed("node", "b").hint("merge"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        hooked = labels.join(near.hint("merge"), "node", "left").select(
            "node", F.col("component").alias("before"), F.least("component", "near").alias("component")
        )
        # a label's own label is at least as small: follow it once
        roots = hooked.select(F.col("node").alias("component"), F.col("component").alias("root"))
        jumped = cut_lineage(
            hooked.join(roots.hint("merge"), "component", "left").select(
                "node", "before", F.least(F.col("component"), F.col("root")).alias("component")
            )
        )
        changed = not jumped.where("component < before").isEmpty()
        labels = jumped.select("node", "component")
        if not changed:
            return labels
    raise RuntimeError(f"components did not converge in {max_rounds} rounds")
