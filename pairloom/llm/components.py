"""Connected components of a graph given by its edges, as iterated joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, settle


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """edges: a, b. Returns id and component (its smallest id), for the ids with edges.

    Every round an id takes the smallest label of its neighbours, and then the label of that label,
    so that long chains shorten fast. Minima are summed before the shuffle; each round's labels go to the shared folder.
    Ends when no label changes.
    """
    both = settle(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("component")), "labels")
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("id").alias("b"), "component"), "b").select(F.col("a").alias("id"), "component")
        least = seen.union(labels.select("id", "component")).groupBy("id").agg(F.min("component").alias("component"))
        least = settle(least, "labels")
        up = labels.select(F.col("id").alias("component"), F.col("component").alias("up"))
        jumped = least.join(up, "component").select("id", F.least("component", "up").alias("component"))
        new = settle(jumped, "labels")
        moved = new.alias("n").join(labels.alias("o"), "id").where(F.col("n.component") != F.col("o.component")).limit(1).count()
        discard(least), discard(labels)
        labels = new
        if not moved:
            discard(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
