"""Graph convolution as joins and sums, for features of small width; `network` scores the full one.

nodes has graph_id, node_id, features (array of `width` numbers); edges has graph_id, src, dst, both ways, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(column: str, width: int) -> list[Column]:
    return [F.get(column, F.lit(k)) for k in range(width)]


def propagate(nodes: DataFrame, edges: DataFrame, width: int) -> DataFrame:
    """Degree-normalised sums over neighbours and the node itself: sum of x / sqrt(d_src * d_dst).

    Every feature is a sum of its own, so no row is multiplied by the width.
    """
    degree = edges.groupBy("graph_id", F.col("dst").alias("node_id")).agg((F.count(F.lit(1)) + 1).alias("d"))
    scaled = nodes.select("graph_id", "node_id", *[c.cast("double").alias(f"x{k}") for k, c in enumerate(_cells("features", width))])
    scaled = scaled.join(degree, ["graph_id", "node_id"], "left").withColumn("s", 1 / F.sqrt(F.coalesce("d", F.lit(1)).cast("double")))
    scaled = scaled.select("graph_id", "node_id", "s", *[(F.col(f"x{k}") * F.col("s")).alias(f"y{k}") for k in range(width)])
    sent = edges.select("graph_id", F.col("src").alias("node_id"), "dst").join(scaled, ["graph_id", "node_id"])
    came = sent.groupBy("graph_id", F.col("dst").alias("node_id")).agg(*[F.sum(f"y{k}").alias(f"m{k}") for k in range(width)])
    d = scaled.join(came, ["graph_id", "node_id"], "left")
    out = [(F.col(f"y{k}") + F.coalesce(f"m{k}", F.lit(0.0))) * F.col("s") for k in range(width)]
    return d.select("graph_id", "node_id", F.array(*out).alias("features"))


def linear(features: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """x W + b; weights by input, then output. The numbers are part of the expression, so keep it for small layers."""
    out = []
    for j, b in enumerate(bias):
        total = F.lit(float(b))
        for i, row in enumerate(weights):
            total = total + F.get(features, F.lit(i)) * F.lit(float(row[j]))
        out.append(total)
    return F.array(*out)


def batch_norm(features: Column, mean: list[float], var: list[float], gamma: list[float], beta: list[float], eps: float = 1e-5) -> Column:
    """With running statistics."""
    cells = [
        (F.get(features, F.lit(k)) - F.lit(float(m))) / F.sqrt(F.lit(float(v) + eps)) * F.lit(float(g)) + F.lit(float(b))
        for k, (m, v, g, b) in enumerate(zip(mean, var, gamma, beta, strict=True))
    ]
    return F.array(*cells)


def batch_statistics(nodes: DataFrame, width: int, batch: str = "batch") -> DataFrame:
    """batch, mean and var (of the population) of every feature, as training uses them."""
    cells = _cells("features", width)
    return nodes.groupBy(batch).agg(F.array(*[F.avg(c) for c in cells]).alias("mean"), F.array(*[F.var_pop(c) for c in cells]).alias("var"))


def relu(features: Column) -> Column:
    return F.transform(features, lambda x: F.greatest(x, F.lit(0.0)))


def mean_pool(nodes: DataFrame, width: int) -> DataFrame:
    """graph_id and the mean features over a graph's nodes, padding nodes included if they are there."""
    return nodes.groupBy("graph_id").agg(F.array(*[F.avg(c) for c in _cells("features", width)]).alias("features"))
