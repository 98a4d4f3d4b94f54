"""Every operator as a query over the star-schema test tables.

Requests and faulty rows are derived from whole tables: arithmetic on a row's
own columns decides what it asks for, so all outcomes occur at every size and
the work grows with the data.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.functions import lookups, rules, text
from tiffin.operators import admission, cross_rules, maintained, quality, rollups
from tiffin.plans import bucketed, cascade, changes, reports
from tiffin.session import durable, name_local_dir, shared_dir
from tiffin.sources import loading, tables, testdata
from tiffin.streaming import guards, maintenance, sinks

Query = Callable[[SparkSession, str], DataFrame]


# ---------------------------------------------------------------- reports

def _report(report: Callable[[dict[str, DataFrame]], DataFrame], load: Callable = testdata.load) -> Query:
    return lambda spark, sf: report(load(spark, sf))


def restaurant_categories(spark: SparkSession, sf: str) -> DataFrame:
    listed = reports.restaurant_categories(testdata.load(spark, sf))
    return listed.select("restaurantname", "page", F.concat_ws(",", "categories").alias("categories"))


def refine_orders(spark: SparkSession, sf: str) -> DataFrame:
    report = reports.orders_with_discounts(testdata.load_by_priority(spark, sf))
    return reports.refine(report, status="delivered", rating=3, sort_key="TotalDiscount", ascending=False)


def refine_orders_by_name(spark: SparkSession, sf: str) -> DataFrame:
    report = reports.orders_by_category(testdata.load(spark, sf))
    return reports.refine(report, status="confirmed", name_contains="7", sort_key="rating")


def count_items(spark: SparkSession, sf: str) -> DataFrame:
    return reports.count_items(count_requests(spark, sf), testdata.load(spark, sf))


def count_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each part asks for its category, under a good, a malformed or an unknown restaurant name."""
    part = testdata.raw(spark, sf, "part")
    category = testdata.category_id()
    return part.select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 5 == 0, "Nowhere Town")
        .otherwise(testdata.restaurant_name()).alias("restaurant_name"),
        F.when(F.col("p_size") % 7 == 0, -category).when(F.col("p_size") % 11 == 0, category + 10)
        .otherwise(category).alias("category_id"))


def categorize_items(spark: SparkSession, sf: str) -> DataFrame:
    return reports.categorize_items(level_requests(spark, sf), testdata.load(spark, sf))


def level_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Each part asks for the level of its name, some with a malformed restaurant or item name."""
    return testdata.raw(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(testdata.restaurant_name())
        .alias("restaurant_name"),
        F.when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit("/x")))
        .when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit("#1"))).otherwise(F.col("p_name"))
        .alias("food_name"))


def categorize_items_collated(spark: SparkSession, sf: str) -> DataFrame:
    """Restaurants named in capitals and items in small letters, compared without case and accents."""
    asked = level_requests(spark, sf).withColumns({"restaurant_name": F.upper("restaurant_name"), "food_name": F.lower("food_name")})
    return reports.categorize_items(asked, testdata.load(spark, sf), collation="UNICODE_CI_AI")


def count_food_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The counts by the SQL function over a whole table of requests; a refused request has none."""
    lookups.register_lookups(spark, testdata.load(spark, sf), strict=False)
    return spark.sql("SELECT seq, count_food(restaurant_name, category_id) AS total_food FROM {asked}", asked=count_requests(spark, sf))


def categorize_food_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The levels by the SQL function over a whole table of requests."""
    lookups.register_lookups(spark, testdata.load(spark, sf), strict=False)
    return spark.sql("SELECT seq, categorize_food(restaurant_name, food_name) AS price_level FROM {asked}",
                     asked=level_requests(spark, sf))


def price_levels_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The items of every restaurant with their level, by the table function."""
    t = testdata.load(spark, sf)
    lookups.register_lookups(spark, t, strict=False)
    return spark.sql("SELECT r.ID AS RID, l.ID, l.name, l.price, l.price_level FROM {r} r, LATERAL price_levels_of(r.name) l", r=t["restaurant"])


def resolve_category(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    requests = testdata.raw(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"), testdata.restaurant_name().alias("restaurant"),
        F.when(F.col("p_size") % 4 == 0, F.lower("p_type")).otherwise(F.col("p_type")).alias("category"))
    return reports.resolve_category(requests, t["category"], t["restaurant"])


# ---------------------------------------------------------------- roll-ups

def order_totals(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    return rollups.order_totals(t["contain"], t["food_item"])


def order_costs(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    return rollups.order_costs(t["food_order"], t["contain"], t["food_item"]).select("ID", "orderCost")


def discount_usage(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    return rollups.discount_usage(t["discount_from_restaurant"], t["apply_for"]).select("code", "used_Count")


def loyalty_points(spark: SparkSession, sf: str) -> DataFrame:
    history = testdata.status_snapshots(testdata.raw(spark, sf, "events"))
    earned = rollups.points_from_snapshots(history)
    return (rollups.loyalty_points(testdata.load(spark, sf)["customer"], earned)
            .select("ID", "exchange_points"))


def loyalty_points_from_changes(spark: SparkSession, sf: str) -> DataFrame:
    earned = rollups.points_from_changes(testdata.status_changes(testdata.raw(spark, sf, "events")))
    return (rollups.loyalty_points(testdata.load(spark, sf)["customer"], earned)
            .select("ID", "exchange_points"))


def price_stats(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    return rollups.price_stats(t["food_item"], t["category"], t["restaurant"])


def application_requests(orders: DataFrame) -> DataFrame:
    """Applications of all orders; urgent ones apply once more with a code that may be
    unknown, high ones repeat their application."""
    first = testdata.applications(orders).withColumn("seq", F.col("FOID") * 2)
    again = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select(
        F.when(F.col("o_orderpriority") == "2-HIGH", testdata.discount_code())
        .otherwise(F.concat(F.lit("DIS_"), F.col("o_custkey").cast("string"))).alias("DFRcode"),
        F.col("o_orderkey").alias("FOID"), (F.col("o_orderkey") * 2 + 1).alias("seq"))
    return first.unionByName(again)


def admit_applications(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    return admission.admit_applications(
        application_requests(testdata.raw(spark, sf, "orders")), t["discount_from_restaurant"],
        t["food_order"], rollups.order_totals(t["contain"], t["food_item"]), stage=durable)


# ---------------------------------------------------------------- quality

def faulty_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with gaps, repeated phones, long names and odd mails where the account balance is low."""
    bal, key = F.col("c_acctbal"), F.col("c_custkey")
    return testdata.raw(spark, sf, "customer").select(
        (key + testdata.CUSTOMER_SHIFT).alias("ID"),
        F.when(bal < 0, F.repeat("c_name", 6)).otherwise(F.col("c_name")).alias("name"),
        F.when(bal < 1000, F.concat(F.lit("c"), key.cast("string"), F.lit("@mail-"), F.lower("c_mktsegment"),
                                    F.lit(".com")))
        .when(bal < 2000, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@mail.vn"))).alias("email"),
        F.lit(0).cast("long").alias("exchange_points"),
        F.when(bal < 500, F.lit(None).cast("string"))
        .when(bal < 3000, F.concat(F.lit("1"), F.lpad(key.cast("string"), 9, "0")))
        .when(bal < 4000, F.concat(F.lit("09"), F.lpad(F.col("c_nationkey").cast("string"), 8, "0")))
        .otherwise(F.concat(F.lit("0"), F.lpad(key.cast("string"), 9, "0"))).alias("phone_number"),
        F.when(bal < 200, F.lit(None).cast("string")).otherwise(F.lit("Street")).alias("address"),
        F.lit("1990-01-01").cast("date").alias("birthdate"),
        F.lpad(key.cast("string"), 16, "0").alias("card_number"), F.col("c_mktsegment").alias("bank_name"))


def faulty_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with statuses, ratings and fees outside their rules where the total price is low."""
    price = F.col("o_totalprice")
    orders = testdata.load(spark, sf)["food_order"].withColumnRenamed("ID", "o_orderkey")
    return (orders.join(testdata.raw(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey")
            .withColumns({
                "order_status": F.when(price < 50000, "shipped").otherwise(F.col("order_status")),
                "Payment_method": F.when(price < 20000, "card").otherwise(F.col("Payment_method")),
                "rating": F.when(price < 60000, 6).when(price < 70000, 0).otherwise(F.col("rating")),
                "delivery_fee": F.when(price < 30000, -1).otherwise(F.col("delivery_fee"))})
            .withColumnRenamed("o_orderkey", "ID").drop("o_totalprice"))


def faulty_discounts(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier discounts with used-up limits, wrong windows and no value where the balance is low."""
    bal = F.col("s_acctbal")
    return testdata.raw(spark, sf, "supplier").select(
        F.concat(F.lit("DIS_"), F.col("s_suppkey").cast("string")).alias("code"),
        F.when(bal < 1000, F.lit(None).cast("long")).when(bal < 2000, F.lit(-1).cast("long"))
        .otherwise(F.lit(10).cast("long")).alias("usageLimit"),
        F.when(bal < 4000, F.lit(11).cast("long")).otherwise(F.lit(10).cast("long")).alias("used_Count"),
        F.lit("2024-12-01").cast("date").alias("start_date"),
        F.date_add(F.lit("2024-12-01").cast("date"), F.when(bal < 5000, 8).otherwise(7)).alias("end_date"),
        F.when(bal < 500, 0).otherwise(5000).alias("value"), F.lit(1).cast("long").alias("RID"))


def q_not_null(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_not_null(faulty_customers(spark, sf), "customer")


def q_key(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_key(testdata.contain_raw(testdata.raw(spark, sf, "lineitem")), "contain")


def q_unique(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_unique(faulty_customers(spark, sf), "customer", ["phone_number"])


def q_foreign_key(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose item left the menu when promotions ended."""
    t = testdata.load(spark, sf)
    kept = t["category"].filter(F.col("name") != "PROMO").select(F.col("ID").alias("categoryID"))
    items = t["food_item"].join(kept, "categoryID", "left_semi")
    return quality.check_foreign_key(t["contain"], "contain", "FIID", items, "ID")


def q_references(spark: SparkSession, sf: str) -> DataFrame:
    """All references of all tables after promotions left the menu and accounts of one segment were closed."""
    t = testdata.load(spark, sf)
    t["category"] = t["category"].filter(F.col("name") != "PROMO")
    t["customer"] = t["customer"].filter(F.col("bank_name") != "MACHINERY")
    t["discount_from_restaurant"] = t["discount_from_restaurant"].filter(F.col("value") > 100_000)
    return quality.check_references(t, list(t), durable)


def q_domain(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_domain(faulty_orders(spark, sf), "food_order")


def q_length(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_length(faulty_customers(spark, sf), "customer")


def q_checks(spark: SparkSession, sf: str) -> DataFrame:
    orders = quality.check_expr(faulty_orders(spark, sf), "food_order")
    return orders.unionByName(quality.check_expr(
        faulty_discounts(spark, sf), "discount_from_restaurant", ["value_positive", "usage_within_limit"]))


def q_window(spark: SparkSession, sf: str) -> DataFrame:
    return quality.check_expr(faulty_discounts(spark, sf), "discount_from_restaurant", ["valid_seven_days"])


def q_check_all(spark: SparkSession, sf: str) -> DataFrame:
    """The whole contract: faulty customers and orders and repeated lines among otherwise sound tables."""
    t = testdata.load(spark, sf)
    t["customer"] = faulty_customers(spark, sf)
    t["food_order"] = faulty_orders(spark, sf)
    t["contain"] = testdata.contain_raw(testdata.raw(spark, sf, "lineitem"))
    return quality.check_all(t, stage=durable)


def q_split_valid(spark: SparkSession, sf: str) -> DataFrame:
    accepted, rejected = quality.split_valid(faulty_customers(spark, sf), "customer")
    return (accepted.select("ID", F.lit(None).cast("string").alias("error"))
            .unionByName(rejected.select("ID", "error")))


def q_line_restaurant(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    return cross_rules.check_line_restaurant(t["contain"], t["food_order"], t["food_item"], t["category"])


def q_discount_cap(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    return cross_rules.check_discount_cap(
        t["apply_for"], t["discount_from_restaurant"], rollups.order_totals(t["contain"], t["food_item"]))


def q_combined_cap(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    return cross_rules.check_combined_cap(
        t["discount_point_apply_for"], t["discount_from_exchange_point"], t["apply_for"],
        t["discount_from_restaurant"], rollups.order_totals(t["contain"], t["food_item"]))


def q_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Every text rule over customers, passwords made of their bank, and part names and brands."""
    customers = faulty_customers(spark, sf)
    by_customer = quality.violations_by_row(customers, "customer", [
        ("email", rules.bad_email(F.col("email")), F.col("email")),
        ("phone", rules.bad_phone(F.col("phone_number")), F.col("phone_number")),
        ("password", rules.short_password(F.concat(F.lit("mậ"), F.col("bank_name"))), F.col("bank_name")),
    ])
    part = testdata.raw(spark, sf, "part")
    odd = (F.when(F.col("p_size") % 4 == 0, F.concat("p_name", F.lit("/2")))
           .when(F.col("p_size") % 9 == 0, "").when(F.col("p_size") % 5 == 0, F.concat("p_name", F.lit("#2")))
           .otherwise(F.col("p_name")))
    items = part.select("p_partkey", odd.alias("name"), "p_brand", (F.col("p_size") - 5).alias("size"))
    by_item = quality.violations_by_row(items, "food_item", [
        ("blank", rules.empty(F.col("name")), F.col("name")),
        ("item_name", rules.bad_item_name(F.col("name")), F.col("name")),
        ("restaurant_name", rules.bad_restaurant_name(F.col("p_brand")), F.col("p_brand")),
        ("category_id", rules.negative(F.col("size")), F.col("size")),
        ("price", rules.not_positive(F.col("size")), F.col("size")),
    ], key=["p_partkey"])
    return by_customer.unionByName(by_item)


def q_exists(spark: SparkSession, sf: str) -> DataFrame:
    """Each order asks for an item id; every other id range is empty."""
    requests = testdata.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 2).alias("ID"))
    return quality.exists_in(requests, testdata.load(spark, sf)["food_item"], {"ID": "ID"}, unique=True)


def q_exists_collated(spark: SparkSession, sf: str) -> DataFrame:
    """Restaurant names asked for in another case and with accents."""
    requests = testdata.raw(spark, sf, "part").select(
        F.col("p_partkey").alias("seq"),
        F.when(F.col("p_size") % 2 == 0, F.replace(F.upper(testdata.restaurant_name()), F.lit("A"), F.lit("À")))
        .when(F.col("p_size") % 3 == 0, F.concat(testdata.restaurant_name(), F.lit(" ")))
        .otherwise(F.lower(testdata.restaurant_name())).alias("name"))
    return quality.exists_in(requests, testdata.load(spark, sf)["restaurant"], {"name": "name"},
                             collation="UNICODE_CI_AI")


def item_requests(spark: SparkSession, sf: str) -> DataFrame:
    """One item per order: some blank, some without a price, some in unknown categories."""
    return testdata.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"),
        F.when(F.col("o_orderpriority") == "5-LOW", "")
        .otherwise(F.concat(F.lit("dish "), F.col("o_custkey").cast("string"))).alias("name"),
        ((F.floor(F.col("o_totalprice") / 100000) - 1) * 1000).cast("int").alias("price"),
        F.lit("").alias("image"), (F.col("o_custkey") % 280).alias("categoryID"))


def q_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    judged = quality.find_duplicates(item_requests(spark, sf), t["food_item"],
                                     ["name", "price", "categoryID"])
    return judged.select("seq", (F.col("stored") | F.col("repeated")).alias("duplicate"))


def q_first_error(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    judged = changes.judge_new_items(item_requests(spark, sf), t["food_item"], t["category"])
    return judged.select("seq", "error")


def lookup_items(spark: SparkSession, sf: str) -> DataFrame:
    """Items looked up by a table of ids."""
    ids = testdata.raw(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("wanted"))
    return tables.lookup(testdata.load(spark, sf)["food_item"], "ID", ids)


# ---------------------------------------------------------------- changes

def _outcome(rows: DataFrame, rejects: DataFrame, columns: list[str]) -> DataFrame:
    """The new table and the rejects as one result."""
    none = {c: F.lit(None).cast(rows.schema[c].dataType) for c in columns if c not in rejects.columns}
    return (rows.select(*columns, F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("error"))
            .unionByName(rejects.withColumns(none).select(*columns, F.col("seq").cast("long"), "error")))


def add_items(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    change = changes.add_items(t["food_item"], t["category"], item_requests(spark, sf),
                               refuse_duplicates=True, stage=durable)
    return _outcome(change.table, change.rejects, ["ID", "name", "price", "categoryID"])


def named_item_requests(spark: SparkSession, sf: str) -> DataFrame:
    orders = testdata.raw(spark, sf, "orders")
    letter = F.char(F.col("o_custkey") % 27 + 65)
    types = F.array(*[F.lit(n) for n in testdata.TYPES])
    return (item_requests(spark, sf).drop("image", "categoryID")
            .join(orders.select(
                F.col("o_orderkey").alias("seq"), F.concat(F.lit("Brand "), letter).alias("restaurant"),
                F.get(types, (F.col("o_custkey") % 6).cast("int")).alias("category"),
                (F.col("o_custkey") * 2).alias("ID")), "seq"))


def add_items_by_name(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    change = changes.add_items_by_name(t["food_item"], t["category"], t["restaurant"],
                                       named_item_requests(spark, sf).drop("ID"), stage=durable)
    return _outcome(change.table, change.rejects, ["ID", "name", "price", "categoryID"])


def update_items(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    requests = item_requests(spark, sf)
    wanted = testdata.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 2).alias("ID"))
    change = changes.update_items(t["food_item"], t["category"], requests.join(wanted, "seq"), stage=durable)
    return _outcome(change.table, change.rejects, ["ID", "name", "price", "categoryID"])


def update_items_by_name(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    change = changes.update_items_by_name(t["food_item"], t["category"], t["restaurant"],
                                          named_item_requests(spark, sf), stage=durable)
    return _outcome(change.table, change.rejects, ["ID", "name", "price", "categoryID"])


def _removed(result: cascade.CascadeResult, rejects: DataFrame | None = None) -> DataFrame:
    keys = result.deleted_keys().withColumn("error", F.lit(None).cast("string"))
    if rejects is None:
        return keys
    return keys.unionByName(rejects.select(
        F.lit("request").alias("table"), F.col("seq").cast("string").alias("key"), "error"))


def item_deletions(spark: SparkSession, sf: str) -> DataFrame:
    return testdata.raw(spark, sf, "orders").select(
        F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 4).alias("ID"))


def order_deletions(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair of events asks twice for one order; every other order, and some that do not exist."""
    return testdata.raw(spark, sf, "events").select(
        F.col("event_id").alias("seq"), (F.shiftright("event_id", 1) * 4).alias("ID"))


def delete_items(spark: SparkSession, sf: str) -> DataFrame:
    done = changes.delete_items(testdata.load(spark, sf), item_deletions(spark, sf), stage=durable)
    return _removed(done.cascade, done.rejects)


def delete_orders(spark: SparkSession, sf: str) -> DataFrame:
    done = changes.delete_orders(testdata.load(spark, sf), order_deletions(spark, sf), stage=durable)
    return _removed(done.cascade, done.rejects)


def items_in_place(spark: SparkSession, sf: str) -> DataFrame:
    """Items and lines kept in buckets, after items changed and others were deleted in place."""
    t = testdata.load(spark, sf)
    kept = bucketed.keep_tables(spark, t, _folder(spark, "buckets"), ["food_item", "contain"], _buckets(spark))
    wanted = testdata.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 2).alias("ID"))
    change = changes.update_items(t["food_item"], t["category"], item_requests(spark, sf).join(wanted, "seq"), stage=durable)
    moved = durable(bucketed.changed_rows(t["food_item"], change.table, "food_item"))
    bucketed.upsert_rows(kept["food_item"], "food_item", moved, 0)
    now = testdata.load(spark, sf)
    now.update(bucketed.read_tables(spark, kept))
    done = changes.delete_items(now, item_deletions(spark, sf), stage=durable)
    bucketed.apply_deletion(kept, done.cascade, 1)
    left = bucketed.read_tables(spark, kept)
    return left["food_item"].select("ID", "price", F.lit(None).cast("long").alias("FOID")).unionByName(
        left["contain"].select(F.col("FIID").alias("ID"), F.col("quantity").alias("price"), "FOID"))


def maintained_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Stored order totals after items changed their price and items and orders were deleted, by the changes alone."""
    t = testdata.load(spark, sf)
    t["contain"] = durable(t["contain"])  # lines are grouped once, not for every step that reads them
    stored = durable(maintained.stored_totals(t["contain"], t["food_item"]))
    wanted = testdata.raw(spark, sf, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") * 2).alias("ID"))
    change = changes.update_items(t["food_item"], t["category"], item_requests(spark, sf).join(wanted, "seq"), stage=durable)
    lines = [done.cascade.deleted["contain"] for done in (
        changes.delete_items(t, item_deletions(spark, sf), stage=durable),
        changes.delete_orders(t, order_deletions(spark, sf), stage=durable))]
    moved = maintained.total_changes(t, removed=lines[0].unionByName(lines[1]), items=change.table, stage=durable)
    return maintained.merged(stored, moved, "FOID", ["total", "lines"], "lines", stage=durable)


def maintained_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Stored counts of applications after orders were deleted and the exchange of codes brought new ones."""
    t = testdata.load(spark, sf)
    stored = durable(t["apply_for"].groupBy("DFRcode").agg(F.count(F.lit(1)).alias("n")))
    gone = changes.delete_orders(t, order_deletions(spark, sf), stage=durable).cascade.deleted["apply_for"]
    added = testdata.raw(spark, sf, "orders").select(
        F.concat(F.lit("DIS_"), (F.col("o_orderkey") % 7).cast("string")).alias("DFRcode"), F.col("o_orderkey").alias("FOID"))
    return maintained.merged(stored, maintained.usage_changes(gone, added), "DFRcode", ["n"], "n", stage=durable)


def add_accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Events register their user; errors ask for a name in use; passwords have 5 to 9 bytes."""
    t = testdata.load(spark, sf)
    user = F.col("user_id").cast("string")
    requests = testdata.raw(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("Customer#"), F.lpad(user, 9, "0")))
        .otherwise(F.concat(F.lit("user"), user)).alias("username"),
        F.substring("props", F.lit(1), (F.col("event_id") % 5 + 5).cast("int")).alias("password"))
    change = changes.add_accounts(t["account"], requests, stage=durable)
    return _outcome(change.table, change.rejects, ["ID", "username", "password"])


def add_customers(spark: SparkSession, sf: str) -> DataFrame:
    """Every customer registers; only the machinery segment is not stored yet.  Neighbours share phone
    and card numbers in groups of different sizes, so who is refused depends on who was accepted before."""
    t = testdata.load(spark, sf)
    key = F.col("c_custkey")
    stored = t["customer"].filter(F.col("bank_name") != "MACHINERY").withColumns({
        "phone_number": F.concat(F.lit("2"), F.substring("phone_number", 2, 9)),
        "card_number": F.concat(F.lit("2"), F.substring("card_number", 2, 15))})
    requests = testdata.raw(spark, sf, "customer").select(
        key.alias("seq"),
        F.when(F.col("c_nationkey") == 3, F.concat("c_name", F.lit("x"))).otherwise(F.col("c_name")).alias("username"),
        F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, F.lit("a@b-c.com"))
        .otherwise(F.concat(F.lit("c"), key.cast("string"), F.lit("@mail.com"))).alias("email"),
        F.concat(F.when(F.col("c_nationkey") == 5, "1").otherwise("0"),
                 F.lpad(F.shiftright("c_custkey", 4).cast("string"), 9, "0")).alias("phone_number"),
        F.lit("Street").alias("address"), F.lit("1990-01-01").cast("date").alias("birthdate"),
        F.lpad(F.floor(key / 24).cast("string"), 16, "0").alias("card_number"),
        F.col("c_mktsegment").alias("bank_name"))
    change = changes.add_customers(stored, t["account"], requests)
    return _outcome(change.table, change.rejects, ["ID", "name", "phone_number", "card_number"])


def login_requests(spark: SparkSession, sf: str) -> DataFrame:
    """All customers and brands ask to be deleted, those in debt with a wrong password."""
    customers = testdata.raw(spark, sf, "customer").select(
        F.col("c_custkey").alias("seq"), F.col("c_name").alias("username"),
        F.when(F.col("c_acctbal") < 5000, "wrong password")
        .otherwise(F.concat(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"))).alias("password"))
    brands = testdata.raw(spark, sf, "part").select(
        (-F.col("p_partkey") - 1).alias("seq"), F.col("p_brand").alias("username"),
        F.concat(F.lit("secret-"), F.col("p_brand")).alias("password"))
    return customers.unionByName(brands)


def delete_accounts(spark: SparkSession, sf: str) -> DataFrame:
    done = changes.delete_accounts(testdata.load(spark, sf), login_requests(spark, sf), stage=durable)
    return _removed(done.cascade, done.rejects)


def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in debt leave with their orders, lines, applications and points."""
    debtors = testdata.raw(spark, sf, "customer").filter(F.col("c_acctbal") < 0).select(
        (F.col("c_custkey") + testdata.CUSTOMER_SHIFT).alias("ID"))
    return _removed(cascade.cascade_delete(testdata.load(spark, sf), "customer", debtors, stage=durable))


def retire_discounts(spark: SparkSession, sf: str) -> DataFrame:
    t = testdata.load(spark, sf)
    t["discount_from_restaurant"] = rollups.discount_usage(t["discount_from_restaurant"], t["apply_for"])
    return _removed(changes.retire_discounts(t, stage=durable))


def load_defaults_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Orders loaded without status, cost and id."""
    t = testdata.load(spark, sf)
    rows = t["food_order"].withColumn("seq", F.col("ID")).drop("ID", "order_status", "orderCost")
    filled = loading.apply_defaults(rows, "food_order").drop("ID")
    numbered = loading.assign_ids(filled, loading.next_id(t["food_order"]), "seq")
    return numbered.select("seq", "ID", "order_status", "orderCost")


def load_items(spark: SparkSession, sf: str) -> DataFrame:
    """Bulk load of the item requests under the contract of the item table."""
    t = testdata.load(spark, sf)
    rows = item_requests(spark, sf).drop("image")
    table, rejects = loading.load_rows(t, "food_item", rows, stage=durable)
    return _outcome(table, rejects.drop("ID"), ["ID", "name", "price", "categoryID"])


def text_formats(spark: SparkSession, sf: str) -> DataFrame:
    return testdata.load(spark, sf)["food_order"].select(
        "ID", text.format_ts(F.col("order_time_stamp")).alias("at"),
        text.format_vnd(F.col("CID") * F.col("delivery_fee")).alias("amount"),
        text.display_rating(F.col("rating")).alias("stars"))


def text_formats_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The same texts and rules through the SQL functions."""
    text.register(spark)
    return spark.sql(
        """SELECT ID, email, is_email(email) AS good_email, is_phone(phone_number) AS good_phone,
                  is_password(bank_name) AS good_password, format_vnd(ID * 1000) AS amount,
                  display_rating(CAST(ID % 3 AS INT)) AS stars
           FROM {customers}""", customers=faulty_customers(spark, sf))


# ---------------------------------------------------------------- streams

def _shuffled(spark: SparkSession, sf: str, name: str, key: str, count: int = 3) -> DataFrame:
    """A table as a stream of micro-batches that rows are dealt to by a hash of ``key``, whatever their time."""
    table = testdata.raw(spark, sf, name)
    path = _folder(spark, f"source-{name}")
    files = max(2, table.rdd.getNumPartitions())
    for i in range(count):
        table.filter(F.pmod(F.xxhash64(key), F.lit(count)) == i).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


def _in_batches(spark: SparkSession, sf: str, name: str, by: str, count: int = 3) -> DataFrame:
    """A table as a stream of micro-batches: its rows in order of ``by``, as many files for each third as a scan has tasks."""
    table = testdata.raw(spark, sf, name)
    path = _folder(spark, f"source-{name}")
    ends = table.agg(F.percentile_approx(F.col(by).cast("timestamp").cast("double") if by == "ts" else F.col(by).cast("double"),
                                         [i / count for i in range(1, count)], 10_000).alias("ends")).first().ends
    place = F.col(by).cast("timestamp").cast("double") if by == "ts" else F.col(by).cast("double")
    part = sum((F.when(place > end, 1).otherwise(0) for end in ends), F.lit(0))
    files = max(2, table.rdd.getNumPartitions())
    for i in range(count):
        table.filter(part == i).repartition(files).write.mode("append").parquet(path)
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(path)


_BY = {"events": "ts", "lineitem": "l_orderkey", "orders": "o_orderkey"}


def _stream(spark: SparkSession, sf: str, name: str, several: bool) -> DataFrame:
    return _in_batches(spark, sf, name, _BY[name]) if several else testdata.raw_stream(spark, sf, name)


def _buckets(spark: SparkSession) -> int:
    """As many buckets for kept state as a shuffle has partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tiffin-{name}-{uuid.uuid4().hex}"


def _update_log(spark: SparkSession, stream: DataFrame, name: str, key: str) -> DataFrame:
    path = _folder(spark, name)
    sinks.open_log(spark, f"{path}/log", stream.schema)
    sinks.drain(sinks.log_writer(stream, f"{path}/log", f"{path}/checkpoint", mode="update"))
    return sinks.latest(sinks.read_log(spark, f"{path}/log", stream.schema), [key])


def stream_points(spark: SparkSession, sf: str, several: bool = False) -> DataFrame:
    """Every change arrives twice."""
    changes_ = testdata.status_changes(_stream(spark, sf, "events", several))
    again = testdata.status_changes(_stream(spark, sf, "events", several))
    return _update_log(spark, maintenance.stream_points(changes_.unionByName(again)), "points", "CID")


def stream_points_from_snapshots(spark: SparkSession, sf: str, several: bool = False) -> DataFrame:
    path = _folder(spark, "snapshots")
    snapshots = testdata.status_snapshots(_stream(spark, sf, "events", several))
    sinks.drain(maintenance.points_from_snapshot_stream(snapshots, path, f"{path}/checkpoint", buckets=_buckets(spark)))
    return maintenance.points_so_far(spark, path)


def stream_points_late(spark: SparkSession, sf: str) -> DataFrame:
    """Points from order states that arrive in any order, each of them twice."""
    path = _folder(spark, "late")
    states = testdata.status_snapshots(_shuffled(spark, sf, "events", "event_id"))
    again = testdata.status_snapshots(_shuffled(spark, sf, "events", "ts"))
    sinks.drain(maintenance.points_from_snapshot_stream(
        states.unionByName(again), path, f"{path}/checkpoint", buckets=_buckets(spark)))
    return maintenance.points_so_far(spark, path)


def stream_order_cost(spark: SparkSession, sf: str, several: bool = False) -> DataFrame:
    t = testdata.load(spark, sf)
    lines = testdata.contain_raw(_stream(spark, sf, "lineitem", several))
    totals = _update_log(spark, maintenance.stream_order_cost(lines, t["food_item"]), "cost", "FOID")
    return maintenance.order_costs_from(t["food_order"], totals)


def stream_usage(spark: SparkSession, sf: str, several: bool = False) -> DataFrame:
    applied = testdata.applications(_stream(spark, sf, "orders", several))
    counts = _update_log(spark, maintenance.stream_usage(applied), "usage", "DFRcode")
    return maintenance.usage_from(testdata.load(spark, sf)["discount_from_restaurant"], counts)


def stream_rejects(spark: SparkSession, sf: str, several: bool = False) -> DataFrame:
    path = _folder(spark, "lines")
    lines, t = testdata.contain_raw(_stream(spark, sf, "lineitem", several)), testdata.load(spark, sf)
    kept = guards.keep_references(spark, t, f"{path}/kept", ["food_order"], _buckets(spark), {"food_order": ["ID", "RID"]}) if several else None
    sinks.drain(guards.guard_lines(lines, t, f"{path}/log", f"{path}/checkpoint", kept))
    return guards.read_judged(spark, f"{path}/log", guards.LINES).drop("batch_id")


def stream_discount_rejects(spark: SparkSession, sf: str, several: bool = False) -> DataFrame:
    path = _folder(spark, "applications")
    applied, t = application_requests(_stream(spark, sf, "orders", several)), testdata.load(spark, sf)
    kept = guards.keep_references(spark, t, f"{path}/kept", ["contain"], _buckets(spark)) if several else None
    sinks.drain(guards.guard_applications(applied, t, f"{path}/log", f"{path}/checkpoint", kept))
    return guards.read_judged(spark, f"{path}/log", guards.APPLICATIONS).drop("batch_id")


def stream_admission(spark: SparkSession, sf: str, several: bool = False) -> DataFrame:
    path = _folder(spark, "admission")
    applied, t = application_requests(_stream(spark, sf, "orders", several)), testdata.load(spark, sf)
    kept = guards.keep_references(spark, t, f"{path}/kept", ["contain", "food_order"], _buckets(spark), {"food_order": ["ID"]}) if several else None
    # the stored applications are the same orders' own and are left out
    sinks.drain(guards.admission(applied, t, f"{path}/log", f"{path}/checkpoint", stored=False, kept=kept,
                                 buckets=_buckets(spark)))
    return guards.read_judged(spark, f"{path}/log", guards.APPLICATIONS).drop("batch_id", "accepted")


def _several(query: Callable[..., DataFrame]) -> Query:
    """The stream query over three micro-batches."""
    return lambda spark, sf: query(spark, sf, several=True)


# ---------------------------------------------------------------- reports and look-ups with parameters

def orders_with_discounts_of_customer(spark: SparkSession, sf: str) -> DataFrame:
    return reports.orders_with_discounts(testdata.load_by_priority(spark, sf), customer_id=testdata.CUSTOMER_SHIFT + 4)


def orders_with_several_discounts(spark: SparkSession, sf: str) -> DataFrame:
    """High orders apply a second discount, their customer's own; discounts of one kind are added up."""
    t = testdata.load_by_priority(spark, sf)
    second = testdata.raw(spark, sf, "orders").filter(F.col("o_orderpriority") == "2-HIGH").select(
        F.concat(F.lit("DIS_"), (F.col("o_orderkey") % 7).cast("string")).alias("DFRcode"),
        F.col("o_orderkey").alias("FOID"))
    t["apply_for"] = t["apply_for"].unionByName(second)
    return reports.orders_with_discounts(t, on_multiple="sum")


def orders_of_category(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with items of one category, highest revenue first."""
    return reports.orders_by_category(testdata.load(spark, sf), category_id=12)


def price_levels_of_restaurant(spark: SparkSession, sf: str) -> DataFrame:
    return reports.price_levels(testdata.load(spark, sf), restaurant="Brand B")


def lookup_item(spark: SparkSession, sf: str) -> DataFrame:
    return tables.lookup(testdata.load(spark, sf)["food_item"], "ID", 17)


def lookup_items_listed(spark: SparkSession, sf: str) -> DataFrame:
    return tables.lookup(testdata.load(spark, sf)["food_item"], "ID", [3, 4, 150, -1])


def load_items_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The item requests as CSV files, loaded with rejects."""
    path = _folder(spark, "csv")
    item_requests(spark, sf).select("name", "price", "image", "categoryID").write.option("header", True).option(
        "nullValue", "\\N").csv(path)
    t = testdata.load(spark, sf)
    rows = loading.read_csv_rows(spark, path, "food_item", ["name", "price", "image", "categoryID"], "\\N")
    rows = rows.withColumn("seq", F.monotonically_increasing_id())
    table, rejects = loading.load_rows(t, "food_item", durable(rows), stage=durable)
    return (table.select("name", "price", "categoryID", F.lit(None).cast("string").alias("error"))
            .unionByName(rejects.select("name", "price", "categoryID", "error")))


def load_items_strict(spark: SparkSession, sf: str) -> DataFrame:
    """Sound item requests only: nothing is refused, so the whole load goes through."""
    t = testdata.load(spark, sf)
    known = t["category"].select(F.col("ID").alias("categoryID"))
    rows = item_requests(spark, sf).filter("name <> '' AND price > 0").join(known, "categoryID", "left_semi").drop("image")
    table, _ = loading.load_rows(t, "food_item", rows, strict=True, stage=durable)
    return table.select("ID", "name", "price", "categoryID")


def load_items_refused(spark: SparkSession, sf: str) -> DataFrame:
    """A strict load of all item requests: it is refused, and tells how many rows each rule refused."""
    rows = item_requests(spark, sf).drop("image")
    try:
        loading.load_rows(testdata.load(spark, sf), "food_item", rows, strict=True, stage=durable)
        refused = {}
    except loading.LoadRefused as told:
        refused = told.refused
    return spark.createDataFrame(list(refused.items()), "rule string, refused long")


def _prepared(query: Query) -> Query:
    """Name a staging folder first where a local session has none."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        name_local_dir(spark)
        return query(spark, sf)
    return run


QUERIES: dict[str, Query] = {
    "menu": _report(reports.menu),
    "restaurant_categories": restaurant_categories,
    "category_directory": _report(reports.category_directory),
    "customer_directory": _report(reports.customer_directory),
    "orders_with_discounts": _report(reports.orders_with_discounts, testdata.load_by_priority),
    "orders_by_category": _report(reports.orders_by_category),
    "item_counts": _report(reports.item_counts),
    "count_items": count_items,
    "price_levels": _report(reports.price_levels),
    "price_stats": price_stats,
    "categorize_items": categorize_items,
    "categorize_items_collated": categorize_items_collated,
    "count_food_sql": count_food_sql,
    "categorize_food_sql": categorize_food_sql,
    "price_levels_sql": price_levels_sql,
    "resolve_category": resolve_category,
    "refine_orders": refine_orders,
    "refine_orders_by_name": refine_orders_by_name,
    "lookup_items": lookup_items,
    "order_totals": order_totals,
    "order_costs": order_costs,
    "discount_usage": discount_usage,
    "loyalty_points": loyalty_points,
    "loyalty_points_from_changes": loyalty_points_from_changes,
    "admit_applications": admit_applications,
    "q_not_null": q_not_null,
    "q_key": q_key,
    "q_unique": q_unique,
    "q_foreign_key": q_foreign_key,
    "q_references": q_references,
    "q_domain": q_domain,
    "q_length": q_length,
    "q_checks": q_checks,
    "q_window": q_window,
    "q_check_all": q_check_all,
    "q_split_valid": q_split_valid,
    "q_line_restaurant": q_line_restaurant,
    "q_discount_cap": q_discount_cap,
    "q_combined_cap": q_combined_cap,
    "q_formats": q_formats,
    "q_exists": q_exists,
    "q_exists_collated": q_exists_collated,
    "q_duplicates": q_duplicates,
    "q_first_error": q_first_error,
    "add_items": add_items,
    "add_items_by_name": add_items_by_name,
    "update_items": update_items,
    "update_items_by_name": update_items_by_name,
    "delete_items": delete_items,
    "delete_orders": delete_orders,
    "items_in_place": items_in_place,
    "maintained_totals": maintained_totals,
    "maintained_usage": maintained_usage,
    "add_accounts": add_accounts,
    "add_customers": add_customers,
    "delete_accounts": delete_accounts,
    "cascade_delete": cascade_delete,
    "retire_discounts": retire_discounts,
    "load_defaults_ids": load_defaults_ids,
    "load_items": load_items,
    "text_formats": text_formats,
    "text_formats_sql": text_formats_sql,
    "stream_points": stream_points,
    "stream_points_from_snapshots": stream_points_from_snapshots,
    "stream_points_late": stream_points_late,
    "stream_order_cost": stream_order_cost,
    "stream_usage": stream_usage,
    "stream_rejects": stream_rejects,
    "stream_discount_rejects": stream_discount_rejects,
    "stream_admission": stream_admission,
    "stream_points_batches": _several(stream_points),
    "stream_points_from_snapshots_batches": _several(stream_points_from_snapshots),
    "stream_order_cost_batches": _several(stream_order_cost),
    "stream_usage_batches": _several(stream_usage),
    "stream_rejects_batches": _several(stream_rejects),
    "stream_discount_rejects_batches": _several(stream_discount_rejects),
    "stream_admission_batches": _several(stream_admission),
    "orders_with_discounts_of_customer": orders_with_discounts_of_customer,
    "orders_with_several_discounts": orders_with_several_discounts,
    "orders_of_category": orders_of_category,
    "price_levels_of_restaurant": price_levels_of_restaurant,
    "lookup_item": lookup_item,
    "lookup_items_listed": lookup_items_listed,
    "load_items_csv": load_items_csv,
    "load_items_strict": load_items_strict,
    "load_items_refused": load_items_refused,
}
QUERIES = {name: _prepared(query) for name, query in QUERIES.items()}
