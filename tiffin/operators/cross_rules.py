"""Rules that compare a row with rows of other tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.functions import rules
from tiffin.operators.skew import spread_join

CAP_PERCENT = 30


def check_line_restaurant(lines: DataFrame, orders: DataFrame, items: DataFrame,
                          categories: DataFrame) -> DataFrame:
    """Order lines with ``error`` set where the item is not of the order's restaurant.

    A missing order or item is refused as well.  All three joins are on stored
    keys; the lines are never grouped, so AQE can split a hot order or item.
    """
    of_order = orders.select(F.col("ID").alias("FOID"), F.col("RID").alias("_order_rid"))
    of_item = (items.select(F.col("ID").alias("FIID"), F.col("categoryID").alias("_category"))
               .join(categories.select(F.col("ID").alias("_category"), F.col("RID").alias("_item_rid")),
                     "_category")
               .select("FIID", "_item_rid"))
    same = F.coalesce(F.col("_order_rid") == F.col("_item_rid"), F.lit(False))
    return (lines.join(of_item, "FIID", "left")
            .join(of_order, "FOID", "left")
            .withColumn("error", F.when(~same, F.lit(rules.MSG_ITEM_RESTAURANT)))
            .select(*lines.columns, "error"))


def check_discount_cap(applications: DataFrame, discounts: DataFrame, totals: DataFrame,
                       percent: int = CAP_PERCENT) -> DataFrame:
    """Applications with ``error`` set where the discount is over ``percent`` of the goods total.

    Whole numbers only: ``value * 100 > total * percent``.  An order without
    lines has no total and an unknown code has no value; both pass here.
    """
    value = discounts.select(F.col("code").alias("DFRcode"), F.col("value").alias("_value"))
    total = totals.select("FOID", F.col("total").alias("_total"))
    over = exceeds(F.col("_value"), F.col("_total"), percent)
    return (spread_join(applications.join(value, "DFRcode", "left"), total, ["FOID"], "left", ["DFRcode"],
                        counts=rows_by_order(applications))
            .withColumn("error", F.when(over, F.lit(rules.MSG_DISCOUNT_CAP)))
            .select(*applications.columns, "error"))


def exceeds(value: Column, total: Column, percent: int = CAP_PERCENT) -> Column:
    return value.cast("long") * 100 > total * percent


def check_combined_cap(point_applications: DataFrame, point_discounts: DataFrame,
                       applications: DataFrame, discounts: DataFrame, totals: DataFrame,
                       percent: int = CAP_PERCENT) -> DataFrame:
    """Exchange-point applications over ``percent`` of the total together with the restaurant discount.

    Dormant in the source system, so nothing else calls it.  Without a
    restaurant discount the sum is NULL and the row passes.
    """
    value = point_discounts.select(F.col("code").alias("DFEPcode"),
                                   F.col("value").cast("long").alias("_points"))
    restaurant = restaurant_discount_by_order(applications, discounts)
    total = totals.select("FOID", F.col("total").alias("_total"))
    sides = restaurant.join(total, "FOID")
    over = exceeds(F.col("_points") + F.col("restaurant_value"), F.col("_total"), percent)
    return (spread_join(point_applications.join(value, "DFEPcode", "left"), sides, ["FOID"], "left",
                        ["DFEPcode"], counts=rows_by_order(point_applications))
            .withColumn("error", F.when(over, F.lit(rules.MSG_COMBINED_CAP)))
            .select(*point_applications.columns, "error"))


def restaurant_discount_by_order(applications: DataFrame, discounts: DataFrame) -> DataFrame:
    value = discounts.select(F.col("code").alias("DFRcode"), F.col("value").cast("long").alias("_v"))
    return (applications.join(value, "DFRcode")
            .groupBy("FOID").agg(F.sum("_v").alias("restaurant_value")))


def rows_by_order(applications: DataFrame) -> DataFrame:
    return applications.groupBy("FOID").agg(F.count(F.lit(1)).alias("n"))
