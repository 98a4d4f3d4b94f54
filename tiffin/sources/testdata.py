"""The star-schema test tables seen as marketplace tables.

Every derivation is a projection of whole tables: every order applies for both kinds
of discount.  ``load_by_priority`` lets only some order priorities carry a discount, so
that reports meet orders with one kind, both and none.
Brands act as restaurants, brand and type as category, parts as items, orders as
orders and line items as order lines.  Ids of customers are shifted so that they
do not meet restaurant ids in the shared account table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, MutableMapping
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Part types in id order, and which priorities carry which discount in ``load_by_priority``.
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
RESTAURANT_DISCOUNT_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")
POINT_DISCOUNT_PRIORITIES = ("3-MEDIUM", "4-NOT SPECIFIED")
CUSTOMER_SHIFT = 1000
STATUS = {"F": "delivered", "O": "confirmed", "P": "pending"}


_schemas: dict[str, StructType] = {}


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table; its schema is read from the file once per process."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _schemas:
        _schemas[path] = spark.read.parquet(path).schema
    return spark.read.schema(_schemas[path]).parquet(path)


def raw_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test files as a file stream."""
    schema = raw(spark, sf_dir, name).schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet")
            .parquet(sf_dir))


def _brand() -> Column:
    return F.substring("p_brand", 7, 10).cast("long")


def category_id() -> Column:
    return _brand() * 10 + F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("p_type"))


def restaurant_name() -> Column:
    """``Brand#3`` as ``Brand C``: restaurant names hold letters and spaces only."""
    return F.concat(F.lit("Brand "), F.char(_brand() + 64))


def _customer_id(column: str) -> Column:
    return F.col(column) + CUSTOMER_SHIFT


def discount_code() -> Column:
    # sixteen neighbouring customers share one restaurant discount
    return F.concat(F.lit("DIS_"), F.shiftright("o_custkey", 4).cast("string"))


def contain_raw(lineitem: DataFrame) -> DataFrame:
    return lineitem.select(F.col("l_orderkey").alias("FOID"), F.col("l_partkey").alias("FIID"),
                           F.col("l_quantity").cast("int").alias("quantity"))


def applications(orders: DataFrame) -> DataFrame:
    return orders.select(
        discount_code().alias("DFRcode"), F.col("o_orderkey").alias("FOID"))


def status_snapshots(events: DataFrame) -> DataFrame:
    """Events of a user as successive states of one order: view = confirmed, purchase = delivered."""
    return events.select(
        F.col("user_id").alias("FOID"), _customer_id("user_id").alias("CID"),
        F.when(F.col("event_type") == "view", "confirmed")
        .when(F.col("event_type") == "purchase", "delivered")
        .otherwise("pending").alias("order_status"),
        F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))


def status_changes(events: DataFrame) -> DataFrame:
    """Events as status changes: a purchase is confirmed -> delivered, others earn nothing."""
    return events.select(
        F.col("event_id").alias("change_id"), F.col("ts").cast("timestamp").alias("at"),
        _customer_id("user_id").alias("CID"),
        F.when(F.col("event_type").isin("view", "click"), "pending").otherwise("confirmed")
        .alias("old_status"),
        F.when(F.col("event_type").isin("purchase", "click"), "delivered").otherwise("confirmed")
        .alias("new_status"))


class MarketplaceTables(MutableMapping):
    """The thirteen tables by name; a table is put together when it is first asked for."""

    def __init__(self, builders: dict[str, Callable[[], DataFrame]]) -> None:
        self._builders = builders
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __setitem__(self, name: str, table: DataFrame) -> None:
        self._builders[name] = lambda: table
        self._built[name] = table

    def __delitem__(self, name: str) -> None:
        del self._builders[name]
        self._built.pop(name, None)

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def load(spark: SparkSession, sf_dir: str) -> MarketplaceTables:
    """All thirteen marketplace tables."""
    read = cache(lambda name: raw(spark, sf_dir, name))
    return MarketplaceTables({
        "account": lambda: _account(read("customer"), read("part")),
        "customer": lambda: _customer(read("customer")),
        "restaurant": lambda: _restaurant(read("part")),
        "discount_from_restaurant": lambda: _restaurant_discount(read("supplier")),
        "discount_from_exchange_point": lambda: _point_discount(read("orders")),
        "category": lambda: read("part").select("p_brand", "p_type").distinct().select(
            category_id().alias("ID"), F.col("p_type").alias("name"), _brand().alias("RID")),
        "food_item": lambda: _food_item(read("part")),
        "food_deliver": lambda: _food_deliver(read("supplier")),
        "food_order": lambda: _food_order(read("orders")),
        "use": lambda: read("orders").select(
            _customer_id("o_custkey").alias("CID"), discount_code().alias("DFRcode")).distinct(),
        "contain": lambda: contain_raw(read("lineitem")).groupBy("FOID", "FIID").agg(
            F.sum("quantity").cast("int").alias("quantity")),
        "apply_for": lambda: applications(read("orders")),
        "discount_point_apply_for": lambda: _point_applications(read("orders")),
    })


def load_by_priority(spark: SparkSession, sf_dir: str) -> MarketplaceTables:
    """As ``load``, but only orders of some priorities carry a restaurant discount, and of some a point discount."""
    t, orders = load(spark, sf_dir), raw(spark, sf_dir, "orders")
    t["apply_for"] = applications(orders.filter(F.col("o_orderpriority").isin(*RESTAURANT_DISCOUNT_PRIORITIES)))
    t["discount_point_apply_for"] = _point_applications(
        orders.filter(F.col("o_orderpriority").isin(*POINT_DISCOUNT_PRIORITIES)))
    return t


def _point_applications(orders: DataFrame) -> DataFrame:
    return orders.select(_point_code().alias("DFEPcode"), F.col("o_orderkey").alias("FOID"))


def _point_code() -> Column:
    return F.concat(F.lit("EXC_"), F.col("o_orderkey").cast("string"))


def _brands(part: DataFrame) -> DataFrame:
    return part.select(_brand().alias("ID"), "p_brand", restaurant_name().alias("name")).distinct()


def _account(customer: DataFrame, part: DataFrame) -> DataFrame:
    customers = customer.select(
        _customer_id("c_custkey").alias("ID"), F.col("c_name").alias("username"),
        F.concat(F.col("c_mktsegment"), F.col("c_nationkey").cast("string")).alias("password"))
    return customers.unionByName(_brands(part).select(
        "ID", F.col("p_brand").alias("username"), F.concat(F.lit("secret-"), F.col("p_brand")).alias("password")))


def _customer(customer: DataFrame) -> DataFrame:
    return customer.select(
        _customer_id("c_custkey").alias("ID"), F.col("c_name").alias("name"),
        F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@"),
                 F.lower("c_mktsegment"), F.lit(".com")).alias("email"),
        F.round(F.col("c_acctbal")).cast("long").alias("exchange_points"),
        F.concat(F.lit("0"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("phone_number"),
        F.concat(F.lit("Nation "), F.col("c_nationkey").cast("string")).alias("address"),
        F.date_add(F.lit("1980-01-01").cast("date"), F.col("c_nationkey") * 100).alias("birthdate"),
        F.lpad(F.col("c_custkey").cast("string"), 16, "0").alias("card_number"),
        F.col("c_mktsegment").alias("bank_name"))


def _restaurant(part: DataFrame) -> DataFrame:
    return _brands(part).select(
        "ID", "name",
        F.concat(F.lit("09"), F.lpad(F.col("ID").cast("string"), 8, "0")).alias("phone_number"),
        F.concat(F.lit("Street "), F.col("ID").cast("string")).alias("address"),
        F.lit("08:00:00").alias("open_hour"), F.lit("22:00:00").alias("close_hour"))


def _restaurant_discount(supplier: DataFrame) -> DataFrame:
    day, key = F.lit("2024-12-01").cast("date"), F.col("s_suppkey")
    return supplier.select(
        F.concat(F.lit("DIS_"), key.cast("string")).alias("code"),
        (key % 50 * 2 + 40).alias("usageLimit"), F.lit(0).cast("long").alias("used_Count"),
        day.alias("start_date"), F.date_add(day, 7).alias("end_date"),
        ((key % 100 + 1) * 50000).cast("int").alias("value"), (key % 20 + 1).alias("RID"))


def _point_discount(orders: DataFrame) -> DataFrame:
    moment = F.lit("2024-12-01 00:00:00").cast("timestamp_ntz")
    return orders.select(
        _point_code().alias("code"), moment.alias("exchange_date"),
        (moment + F.expr("INTERVAL 7 DAYS")).alias("end_date"),
        (F.col("o_custkey") % 90 * 1000 + 10000).cast("int").alias("value"),
        _customer_id("o_custkey").alias("CID"))


def _food_item(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("ID"), F.col("p_name").alias("name"),
        F.round(F.col("p_retailprice") * 100).cast("int").alias("price"),
        F.lit("").alias("image"), category_id().alias("categoryID"))


def _food_deliver(supplier: DataFrame) -> DataFrame:
    key = F.col("s_suppkey")
    return supplier.select(
        (key + 1).alias("ID"), F.concat(F.lit("03"), F.lpad(key.cast("string"), 8, "0")).alias("phone_number"),
        F.concat(F.lit("59A-"), key.cast("string")).alias("vehicle_number"), F.col("s_name").alias("name"))


def _food_order(orders: DataFrame) -> DataFrame:
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return orders.select(
        key.alias("ID"), F.when(key % 2 == 0, "CARD").otherwise("CASH").alias("Payment_method"),
        F.concat(F.lit("Lane "), F.col("o_custkey").cast("string")).alias("address"),
        F.when(status == "F", STATUS["F"]).when(status == "O", STATUS["O"])
        .otherwise(STATUS["P"]).alias("order_status"),
        F.col("o_orderdate").alias("order_time_stamp"), F.lit("").alias("review"),
        F.when(key % 7 != 0, (key % 5 + 1).cast("int")).alias("rating"),
        F.lit(0).cast("long").alias("orderCost"),
        F.when(status == "F", "delivered").when(status == "O", "delivering").alias("ship_status"),
        F.when(status == "F", "finished").when(status == "O", "in_process").alias("get_status"),
        (key % 3 * 500 + 1500).cast("int").alias("delivery_fee"),
        _customer_id("o_custkey").alias("CID"), (key % 25 + 1).alias("RID"),
        (F.shiftright("o_custkey", 4) + 1).alias("FDID"))
