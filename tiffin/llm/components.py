"""Connected components of a link table, by alternating large and small stars.

Each step is an aggregation and a join over the links; a node's links are never
gathered, and no link or label reaches the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]


def _star(links: DataFrame, stage: Stage, large: bool) -> DataFrame:
    """Link every neighbour (large: the larger ones; small: the smaller ones and the node) to the least one."""
    if large:
        near = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")))
    met = near.join(least, "a")
    if large:
        out = met.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return stage(out.filter("a != b").distinct())


def components(links: DataFrame, stage: Stage) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every linked node that is not itself the smallest.

    Nulls and loops are ignored.  The number of rounds grows with the logarithm of the
    longest chain.
    """
    current = stage(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        current = _star(_star(current, stage, large=True), stage, large=False)
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("points"), F.lit(0).alias("centre")).unionByName(
            current.select(F.col("b").alias("node"), F.lit(0).alias("points"), F.lit(1).alias("centre")))
        # done once every node points to one centre and no centre points on
        loose = ends.groupBy("node").agg(F.sum("points").alias("points"), F.max("centre").alias("centre"))
        if loose.filter("points + centre > 1").isEmpty():
            return current.toDF("node", "component")
