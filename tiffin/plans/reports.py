"""The marketplace reports, each for all entities at once; a parameter narrows it to one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.functions import rules
from tiffin.operators.quality import exists_in
from tiffin.operators.rollups import (
    items_by_restaurant,
    order_totals,
    price_stats,
    priced_lines,
)
from tiffin.operators.skew import paged_lists, spread_join

Tables = Mapping[str, DataFrame]

SORT_KEYS = ("OrderID", "TotalDiscount", "TotalOrderPrice", "OrderTimestamp", "OrderTime",
             "TotalRevenue", "TotalItems", "rating")


def menu(t: Tables) -> DataFrame:
    """``(rname, cname, name, price, ID)`` of every item on offer."""
    return (items_by_restaurant(t["food_item"], t["category"], t["restaurant"])
            .select("rname", "cname", "name", "price", "ID"))


def restaurant_categories(t: Tables, page_rows: int = 10_000) -> DataFrame:
    """``(restaurantname, page, categories)``: the category names of each restaurant name, by id.

    Restaurants of one name are merged.  A category whose restaurant is gone is
    listed under a NULL name.  Up to ``page_rows`` names are one row (page 0).
    """
    names = t["restaurant"].select(F.col("ID").alias("RID"), F.col("name").alias("restaurantname"))
    # the group key must not be NULL, so it travels as a one-field text
    joined = (t["category"].join(names, "RID", "left")
              .select("ID", F.to_json(F.struct("restaurantname")).alias("_key"), "name"))
    paged = paged_lists(joined, "_key", "ID", "name", "categories", page_rows)
    return paged.select(
        F.get_json_object("_key", "$.restaurantname").alias("restaurantname"), "page", "categories")


def category_directory(t: Tables) -> DataFrame:
    """``(ID, categoryName, resName)`` by id."""
    names = t["restaurant"].select(F.col("ID").alias("RID"), F.col("name").alias("resName"))
    return (t["category"].join(names, "RID")
            .select("ID", F.col("name").alias("categoryName"), "resName")
            .orderBy("ID"))


def customer_directory(t: Tables) -> DataFrame:
    return t["customer"]


def orders_with_discounts(t: Tables, customer_id: int | None = None,
                          on_multiple: str = "error") -> DataFrame:
    """Orders that carry a discount of either kind, with goods total and both discounts.

    Goods total is without fee and discounts, and NULL for an order without
    lines.  An order with several discounts of one kind is an error, or their sum
    with ``on_multiple='sum'``.

    Both kinds go through one aggregate by order, whose inner join with the
    orders is the "has one or the other" condition, and lines are summed before
    they meet the orders: every join has at most one row per order on each side.
    """
    orders = t["food_order"]
    lines = t["contain"]
    given = _given_discounts(t)
    if customer_id is not None:
        orders = orders.filter(F.col("CID") == customer_id)
        wanted = orders.select(F.col("ID").alias("FOID"))
        lines = lines.join(wanted, "FOID", "left_semi")
        given = given.join(wanted, "FOID", "left_semi")

    def side(total: str, count: str) -> Column:
        if on_multiple == "sum":
            return F.coalesce(F.col(total), F.lit(0))
        several = F.raise_error(F.concat(
            F.lit("more than one discount of one kind on order "), F.col("OrderID").cast("string")))
        return F.when(F.col(count) > 1, several.cast("long")).otherwise(F.coalesce(F.col(total), F.lit(0)))

    discounts = given.groupBy("FOID").agg(
        F.sum("_restaurant").alias("_rsum"), F.count("_restaurant").alias("_rn"),
        F.sum("_points").alias("_psum"), F.count("_points").alias("_pn"))
    totals = order_totals(lines, t["food_item"]).withColumnRenamed("total", "TotalOrderPrice")
    report = (orders.withColumnRenamed("ID", "FOID")
              .join(discounts, "FOID")
              .join(totals, "FOID", "left")
              .select(F.col("FOID").alias("OrderID"), "Payment_method",
                      F.col("address").alias("OrderAddress"), F.col("order_status").alias("OrderStatus"),
                      F.col("order_time_stamp").alias("OrderTimestamp"), "review", "rating",
                      F.col("ship_status").alias("ShippingStatus"), F.col("get_status").alias("GetStatus"),
                      "delivery_fee", "TotalOrderPrice", "_rsum", "_rn", "_psum", "_pn")
              .withColumn("RestaurantDiscount", side("_rsum", "_rn"))
              .withColumn("ExchangePointDiscount", side("_psum", "_pn"))
              .drop("_rsum", "_rn", "_psum", "_pn"))
    return report.withColumn("TotalDiscount", F.col("RestaurantDiscount") + F.col("ExchangePointDiscount"))


def _given_discounts(t: Tables) -> DataFrame:
    """``(FOID, _restaurant, _points)``: one row per application, the other kind's column NULL."""
    none = F.lit(None).cast("long")
    value = F.col("value").cast("long")
    restaurant = (t["apply_for"]
                  .join(t["discount_from_restaurant"].select(F.col("code").alias("DFRcode"), value.alias("_v")),
                        "DFRcode")
                  .select("FOID", F.col("_v").alias("_restaurant"), none.alias("_points")))
    points = (t["discount_point_apply_for"]
              .join(t["discount_from_exchange_point"].select(F.col("code").alias("DFEPcode"), value.alias("_v")),
                    "DFEPcode")
              .select("FOID", none.alias("_restaurant"), F.col("_v").alias("_points")))
    return restaurant.unionByName(points)


def orders_by_category(t: Tables, category_id: int | None = None) -> DataFrame:
    """Per category the orders that contain its items; only that category's lines are counted.

    For one category the result is sorted by revenue, highest first.
    """
    items = t["food_item"]
    if category_id is not None:
        items = items.filter(F.col("categoryID") == category_id)
    sums = (priced_lines(t["contain"], items)
            .groupBy("categoryID", "FOID")
            .agg(F.sum(F.col("quantity").cast("long")).alias("TotalItems"), F.sum("amount").alias("TotalRevenue"))
            .filter(F.col("TotalItems") > 0))
    orders = t["food_order"].select(
        F.col("ID").alias("FOID"), "CID", F.col("order_time_stamp").alias("OrderTime"), "rating",
        F.col("order_status").alias("OrderStatus"))
    names = t["customer"].select(F.col("ID").alias("CID"), F.col("name").alias("CustomerName"))
    columns = [F.col("FOID").alias("OrderID"), "OrderTime", "rating", "CustomerName", "TotalItems",
               "OrderStatus", "TotalRevenue"]
    if category_id is None:
        # an order has several categories: name the orders before they are multiplied
        return sums.join(orders.join(names, "CID"), "FOID").select("categoryID", *columns)
    return (sums.join(orders, "FOID").join(names, "CID").select(*columns)
            .orderBy(F.desc("TotalRevenue"), "OrderID"))


def item_counts(t: Tables) -> DataFrame:
    """``(rname, categoryID, total_food)`` for every category, 0 where it has no item."""
    n = t["food_item"].groupBy("categoryID").agg(F.count(F.lit(1)).alias("_n"))
    names = t["restaurant"].select(F.col("ID").alias("RID"), F.col("name").alias("rname"))
    return (t["category"].select(F.col("ID").alias("categoryID"), "RID")
            .join(names, "RID")
            .join(n, "categoryID", "left")
            .select("rname", "categoryID", F.coalesce(F.col("_n"), F.lit(0)).alias("total_food")))


def count_items(requests: DataFrame, t: Tables, collation: str | None = None) -> DataFrame:
    """``requests (restaurant_name, category_id)`` with ``total_food``, or ``error`` and no count.

    A category of another restaurant, or an unknown one, counts 0.
    """
    known = exists_in(requests, t["restaurant"], {"restaurant_name": "name"}, "_known", collation=collation)
    counts = item_counts(t)
    temp = counts.select(_folded(F.col("rname"), collation).alias("_name"),
                         F.col("categoryID").alias("_cat"), "total_food")
    asked = known.withColumns({"_name": _folded(F.col("restaurant_name"), collation),
                               "_cat": F.col("category_id").cast("long")})
    joined = spread_join(asked, temp, ["_name", "_cat"], "left", requests.columns)
    name = F.col("restaurant_name")
    error = rules.first_error(
        (rules.negative(F.col("category_id")), rules.MSG_CATEGORY_ID),
        (F.coalesce(rules.bad_restaurant_name(name), F.lit(True)), rules.MSG_RESTAURANT_NAME),
        (~F.col("_known"), rules.MSG_RESTAURANT))
    return (joined.withColumn("error", error)
            .withColumn("total_food", F.when(F.col("error").isNull(),
                                             F.coalesce(F.col("total_food"), F.lit(0))))
            .select(*requests.columns, "total_food", "error"))


def _folded(name: Column, collation: str | None) -> Column:
    return F.collate(name, collation) if collation else name


def price_levels(t: Tables, restaurant: str | None = None, key: str = "name", collation: str | None = None) -> DataFrame:
    """``(rname, ID, name, price, price_level)`` of every item, or of one restaurant's (its name compared by ``collation``).

    High: at least half way from the average to the maximum; Low: at most half
    way from the average to the minimum; High is tested first.  The statistics
    are one aggregate joined back, and a restaurant with very many items is
    spread by the counts that aggregate already holds.
    """
    places = t["restaurant"]
    if restaurant is not None:
        places = places.filter(_folded(F.col("name"), collation) == restaurant)
    group = "rname" if key == "name" else "RID"
    stats = price_stats(t["food_item"], t["category"], places, key)
    items = items_by_restaurant(t["food_item"], t["category"], places)
    joined = spread_join(items, stats, [group], "inner", ["ID"], counted="n")
    return joined.select("rname", "ID", "name", "price", _level().alias("price_level"))


def _level() -> Column:
    twice = F.col("price").cast("long") * 2
    return (F.when(twice >= F.col("avg_price") + F.col("max_price"), "High")
            .when(twice <= F.col("avg_price") + F.col("min_price"), "Low")
            .otherwise("Medium"))


def categorize_items(requests: DataFrame, t: Tables, collation: str | None = None) -> DataFrame:
    """``requests (restaurant_name, food_name)`` with ``price_level``, or ``error`` and no level.

    A name carried by several items of the restaurant is an error; with ``collation`` so are names that it holds equal.
    """
    names = {"_restaurant": "restaurant_name", "_food": "food_name"}
    named = (price_levels(t).groupBy(_folded(F.col("rname"), collation).alias("_restaurant"), _folded(F.col("name"), collation).alias("_food"))
             .agg(F.count(F.lit(1)).alias("_same"), F.min("price_level").alias("price_level")))
    asked = requests.withColumns({k: _folded(F.col(c), collation) for k, c in names.items()})
    joined = spread_join(asked, named, list(names), "left", requests.columns)
    error = rules.first_error(
        (rules.bad_restaurant_name(F.col("restaurant_name")), rules.MSG_RESTAURANT_NAME),
        (rules.bad_item_name(F.col("food_name")), rules.MSG_ITEM_NAME),
        (F.col("_same").isNull(), rules.MSG_ITEM_OF_RESTAURANT),
        (F.col("_same") > 1, rules.MSG_AMBIGUOUS))
    return (joined.withColumn("error", error)
            .withColumn("price_level", F.when(F.col("error").isNull(), F.col("price_level")))
            .select(*requests.columns, "price_level", "error"))


def refine(report: DataFrame, status: str | None = None, rating: int | None = None,
           name_contains: str | None = None, sort_key: str | None = None,
           ascending: bool = True) -> DataFrame:
    """Filter and sort an order report the way its viewer does.

    Empty arguments filter nothing.  A NULL never matches a filter and sorts as
    the lowest value.
    """
    out = report
    if status:
        out = out.filter(F.col("OrderStatus") == status)
    if rating:
        out = out.filter(F.col("rating") == int(rating))
    if name_contains:
        out = out.filter(F.col("CustomerName").contains(name_contains))
    if sort_key:
        if sort_key not in SORT_KEYS:
            raise ValueError(f"cannot sort by {sort_key}")
        column = F.col(sort_key)
        out = out.orderBy(column.asc_nulls_first() if ascending else column.desc_nulls_last(), "OrderID")
    return out


def resolve_category(requests: DataFrame, categories: DataFrame, restaurants: DataFrame,
                     collation: str | None = None) -> DataFrame:
    """``requests (restaurant, category)`` with ``categoryID``, NULL when no such pair of names exists.

    If several categories fit, the smallest id is taken.
    """
    names = restaurants.select(F.col("ID").alias("RID"), F.col("name").alias("_rname"))
    ids = (categories.select("RID", F.col("name").alias("_cname"), F.col("ID").alias("categoryID"))
           .join(names, "RID")
           .groupBy(_folded(F.col("_rname"), collation).alias("_r"), _folded(F.col("_cname"), collation).alias("_c"))
           .agg(F.min("categoryID").alias("categoryID")))
    asked = requests.withColumns({"_r": _folded(F.col("restaurant"), collation),
                                  "_c": _folded(F.col("category"), collation)})
    return spread_join(asked, ids, ["_r", "_c"], "left", requests.columns).drop("_r", "_c")
