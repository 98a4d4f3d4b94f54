"""Questions about stored tables as SQL functions: ``count_food``, ``categorize_food`` and ``price_levels_of``.

The bodies are SQL, so a call over a table is planned as a join with an aggregate of the
stored tables, whatever the number of rows that ask, and no Python runs.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.functions import rules
from tiffin.plans import reports

_AMBIGUOUS = "ambiguous"


def _said(message: str, strict: bool) -> str:
    return "raise_error('{}')".format(message.replace("'", "\\'")) if strict else "NULL"


def register_lookups(spark: SparkSession, t: Mapping[str, DataFrame], strict: bool = True) -> None:
    """Offer the functions to SQL for the session, over the tables ``t`` as temporary views.

    ``strict`` raises for a malformed or unknown name, as the source system does; else the answer is NULL.
    Restaurants of one name are one, as in ``price_levels``.
    """
    counts = reports.item_counts(t)
    counts.groupBy("rname", "categoryID").agg(F.sum("total_food").alias("n")).createOrReplaceTempView("tiffin_item_counts")
    t["restaurant"].select(F.col("name").alias("rname")).distinct().createOrReplaceTempView("tiffin_restaurant_names")
    levels = reports.price_levels(t)
    levels.createOrReplaceTempView("tiffin_price_levels")
    level = F.when(F.count(F.lit(1)) > 1, F.lit(_AMBIGUOUS)).otherwise(F.min("price_level"))
    levels.groupBy("rname", "name").agg(level.alias("level")).createOrReplaceTempView("tiffin_named_levels")
    bodies = {
        "tiffin_level(level STRING) RETURNS STRING": f"""
            CASE WHEN level IS NULL THEN {_said(rules.MSG_ITEM_OF_RESTAURANT, strict)}
                 WHEN level = '{_AMBIGUOUS}' THEN {_said(rules.MSG_AMBIGUOUS, strict)} ELSE level END""",
        "tiffin_count(known BOOLEAN, n BIGINT) RETURNS BIGINT": f"""
            CASE WHEN known THEN coalesce(n, 0) ELSE {_said(rules.MSG_RESTAURANT, strict)} END""",
        "count_food(restaurant_name STRING, category_id BIGINT) RETURNS BIGINT": f"""
            CASE WHEN count_food.category_id < 0 THEN {_said(rules.MSG_CATEGORY_ID, strict)}
                 WHEN coalesce(NOT count_food.restaurant_name RLIKE r'{rules.RESTAURANT_NAME}', true)
                 THEN {_said(rules.MSG_RESTAURANT_NAME, strict)}
                 ELSE tiffin_count(
                   (SELECT count(*) > 0 FROM tiffin_restaurant_names k WHERE k.rname = count_food.restaurant_name),
                   (SELECT sum(c.n) FROM tiffin_item_counts c
                    WHERE c.rname = count_food.restaurant_name AND c.categoryID = count_food.category_id)) END""",
        "categorize_food(restaurant_name STRING, food_name STRING) RETURNS STRING": f"""
            CASE WHEN NOT categorize_food.restaurant_name RLIKE r'{rules.RESTAURANT_NAME}'
                 THEN {_said(rules.MSG_RESTAURANT_NAME, strict)}
                 WHEN NOT categorize_food.food_name RLIKE r'{rules.ITEM_NAME}' THEN {_said(rules.MSG_ITEM_NAME, strict)}
                 ELSE tiffin_level((SELECT min(l.level) FROM tiffin_named_levels l
                                    WHERE l.rname = categorize_food.restaurant_name AND l.name = categorize_food.food_name)) END""",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.sql("""
        CREATE OR REPLACE TEMPORARY FUNCTION price_levels_of(restaurant STRING)
        RETURNS TABLE (rname STRING, ID BIGINT, name STRING, price INT, price_level STRING)
        RETURN SELECT l.rname, l.ID, l.name, l.price, l.price_level FROM tiffin_price_levels l
               WHERE l.rname = price_levels_of.restaurant""")
