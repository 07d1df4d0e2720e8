"""Running sums and maxima over all rows in an order, range by range, so that no task orders more than one range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RANGES = 256


def before_row(rows: DataFrame, order: str, value: Column, name: str, largest: bool = False, ranges: int = RANGES) -> DataFrame:
    """rows with `name`: the sum (or the largest) of value over all rows before each row by `order`; null for the first.

    Ranges are cut at approximate percentiles of `order` (a number or a date); their totals, at most `ranges` rows, are
    carried over to the ranges behind. Rows with equal `order` are in one range, in any order.
    """
    total = F.max if largest else F.sum
    shares = F.array(*[F.lit(i / ranges) for i in range(1, ranges)])
    cuts = rows.agg(F.percentile_approx(order, shares, F.lit(10 * ranges))).first()[0] or []
    place = F.lit(0)
    if cuts:
        place = F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(order)))
    d = rows.withColumn("_range", place).withColumn("_value", value)
    upto = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("_range").agg(total("_value").alias("_total"))
    carried = totals.select("_range", total("_total").over(upto(Window.orderBy("_range"))).alias("_carried"))
    d = d.withColumn("_own", total("_value").over(upto(Window.partitionBy("_range").orderBy(order)))).join(F.broadcast(carried), "_range")
    both = F.greatest("_own", "_carried") if largest else F.coalesce(F.col("_own") + F.col("_carried"), "_own", "_carried")
    return d.withColumn(name, both).drop("_range", "_value", "_own", "_carried")
