"""Aggregates that the source system keeps up to date row by row, computed for all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.operators.skew import transition_counts

POINTS_PER_DELIVERY = 20


def priced_lines(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Lines with ``amount = price * quantity`` and the item's category."""
    priced = items.select(F.col("ID").alias("FIID"), F.col("price").cast("long").alias("_price"),
                          "categoryID")
    return (lines.join(priced, "FIID")
            .withColumn("amount", F.col("_price") * F.col("quantity"))
            .drop("_price"))


def order_totals(lines: DataFrame, items: DataFrame) -> DataFrame:
    """``(FOID, total)``: goods value per order that has lines."""
    return priced_lines(lines, items).groupBy("FOID").agg(F.sum("amount").alias("total"))


def order_costs(orders: DataFrame, lines: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with ``orderCost`` recomputed: goods total plus delivery fee, 0 without lines.

    The source system refreshes the cost only when a line is added; recomputing
    gives the same value for such a history and also follows deletions.
    """
    totals = order_totals(lines, items).withColumnRenamed("FOID", "ID")
    return _with_cost(orders, totals)


def _with_cost(orders: DataFrame, totals: DataFrame) -> DataFrame:
    cost = F.coalesce(F.col("total") + F.col("delivery_fee"), F.lit(0).cast("long"))
    return orders.join(totals, "ID", "left").withColumn("orderCost", cost).drop("total")


def discount_usage(discounts: DataFrame, applications: DataFrame) -> DataFrame:
    """Discounts with ``used_Count`` raised by their applications."""
    uses = applications.groupBy("DFRcode").agg(F.count(F.lit(1)).alias("_n"))
    return (discounts.join(uses.withColumnRenamed("DFRcode", "code"), "code", "left")
            .withColumn("used_Count", F.col("used_Count") + F.coalesce(F.col("_n"), F.lit(0)))
            .select(*discounts.columns))


def points_from_changes(changes: DataFrame, points: int = POINTS_PER_DELIVERY) -> DataFrame:
    """``(CID, points)`` from status changes ``(CID, old_status, new_status)``."""
    return (changes.filter((F.col("old_status") == "confirmed") & (F.col("new_status") == "delivered"))
            .groupBy("CID").agg((F.count(F.lit(1)) * points).alias("points")))


def points_from_snapshots(snapshots: DataFrame, points: int = POINTS_PER_DELIVERY,
                          before: str = "confirmed", after: str = "delivered",
                          bucket: str = "hour") -> DataFrame:
    """``(CID, points)`` from successive states ``(FOID, CID, order_status, at, seq)`` of the orders."""
    steps = transition_counts(snapshots, ["FOID", "CID"], "order_status", "at", "seq",
                              before, after, bucket)
    return steps.groupBy("CID").agg((F.sum("n") * points).alias("points"))


def loyalty_points(customers: DataFrame, earned: DataFrame) -> DataFrame:
    """Customers with ``earned`` points added; NULL points count as 0 once something is earned."""
    total = F.when(F.col("points").isNull(), F.col("exchange_points")).otherwise(
        F.coalesce(F.col("exchange_points"), F.lit(0)) + F.col("points"))
    return (customers.join(earned.withColumnRenamed("CID", "ID"), "ID", "left")
            .withColumn("exchange_points", total)
            .select(*customers.columns))


def items_by_restaurant(items: DataFrame, categories: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Items with the names of their category and restaurant.

    The two small tables are joined to each other first, so the items are
    joined (and, if large, shuffled) once.
    """
    places = (categories.select(F.col("ID").alias("categoryID"), F.col("name").alias("cname"), "RID")
              .join(restaurants.select(F.col("ID").alias("RID"), F.col("name").alias("rname")), "RID"))
    return items.join(places, "categoryID")


def price_stats(items: DataFrame, categories: DataFrame, restaurants: DataFrame,
                key: str = "name") -> DataFrame:
    """``(rname | RID, avg_price, min_price, max_price, n)``.

    ``key='name'`` merges restaurants of one name, as the source system does;
    ``key='id'`` keeps them apart.  The average is rounded half up to a whole
    price, in integer arithmetic.
    """
    group = "rname" if key == "name" else "RID"
    total, n = F.sum(F.col("price").cast("long")), F.count("price")
    return (items_by_restaurant(items, categories, restaurants)
            .groupBy(group)
            .agg(total.alias("_sum"), F.min("price").alias("min_price"),
                 F.max("price").alias("max_price"), n.alias("n"))
            .withColumn("avg_price", F.expr("(2 * _sum + n) div (2 * n)"))
            .select(group, "avg_price", "min_price", "max_price", "n"))
