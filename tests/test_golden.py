"""Known results on the seed marketplace."""

import pytest
from pyspark.sql import functions as F

from tiffin.operators import cross_rules, quality, rollups
from tiffin.operators.admission import admit_applications
from tiffin.plans import reports

# The results the marketplace must give.
COSTS = [
    219000, 195000, 249000, 492000, 155000, 720000, 130000, 384000, 435000, 1550000, 135000, 100000, 475000,
    287000, 70000, 275000, 355000, 301000, 705000, 135000, 945000, 94000, 95000, 710000, 191000, 183000, 241000,
    120000, 305000, 335000, 375000, 95000, 522000, 462000, 385000, 799000, 194000, 430000]
DISCOUNTED = {
    1: [(1, 204000, 5000, 0, 5000), (4, 477000, 20000, 0, 20000), (10, 1530000, 20000, 0, 20000),
        (27, 226000, 5000, 0, 5000), (28, 105000, 10000, 0, 10000), (29, 280000, 20000, 0, 20000)],
    2: [(2, 180000, 10000, 30000, 40000), (13, 460000, 10000, 0, 10000), (30, 320000, 5000, 0, 5000),
        (31, 360000, 10000, 0, 10000), (32, 80000, 20000, 0, 20000)],
    3: [(3, 234000, 5000, 0, 5000), (11, 120000, 20000, 0, 20000), (33, 507000, 20000, 0, 20000),
        (34, 445000, 20000, 0, 20000), (35, 370000, 5000, 0, 5000)]}
BY_CATEGORY = {
    1: [(21, 9, 930000), (38, 9, 414000), (35, 5, 370000), (8, 8, 364000), (17, 5, 340000), (30, 9, 320000),
        (18, 7, 286000), (14, 4, 272000), (3, 4, 234000), (27, 5, 226000), (1, 3, 204000), (26, 4, 170000),
        (5, 2, 130000)],
    2: [(19, 9, 690000), (13, 6, 460000), (9, 6, 420000), (31, 5, 360000), (16, 4, 260000), (2, 2, 180000),
        (28, 2, 105000), (22, 1, 80000)],
    3: [(29, 7, 280000), (11, 3, 120000), (20, 3, 120000), (23, 2, 80000), (32, 2, 80000)]}
COUNTS = {1: 10, 2: 5, 3: 1, 4: 1, 7: 1, 8: 1, 9: 6, 10: 2, 11: 1, 12: 1, 13: 1, 14: 1, 15: 5, 16: 1, 17: 1,
          19: 1, 20: 2}
LEVELS = {
    "High": {31, 33, 35, 4, 8, 9, 10, 13, 36, 37, 15, 16, 17, 18, 19, 23, 24, 25},
    "Medium": {1, 30, 34, 5, 7, 14, 38, 39, 40, 21, 22},
    "Low": {2, 3, 29, 32, 6, 11, 12, 41, 20, 26, 27, 28}}
STATS = {6: (77800, 30000, 140000), 7: (67000, 45000, 90000), 8: (30000, 20000, 40000), 9: (27500, 10000, 45000),
         10: (147750, 109000, 169000), 18: (130400, 30000, 239000)}
USAGE = {"DIS_HH5": 11, "DIS_PLT10": 8, "DIS_BTN20": 5, "DIS_COMPANY1": 5, "DIS_SPECIAL2": 4, "DIS_PVN10": 1,
         "DIS_BotChien10": 1}


def totals(t):
    return rollups.order_totals(t["contain"], t["food_item"])


def test_contract_holds(seed):
    assert quality.check_all(seed).collect() == []


def test_lines_and_discounts_are_accepted(seed):
    lines = cross_rules.check_line_restaurant(seed["contain"], seed["food_order"], seed["food_item"], seed["category"])
    assert lines.filter("error IS NOT NULL").count() == 0 and lines.count() == 62
    capped = cross_rules.check_discount_cap(seed["apply_for"], seed["discount_from_restaurant"], totals(seed))
    assert capped.filter("error IS NOT NULL").count() == 0 and capped.count() == 35


def test_order_costs(seed):
    rows = rollups.order_costs(seed["food_order"], seed["contain"], seed["food_item"]).orderBy("ID").collect()
    assert [r["orderCost"] for r in rows] == COSTS


def test_discount_usage(seed):
    rows = rollups.discount_usage(seed["discount_from_restaurant"], seed["apply_for"]).collect()
    assert {r["code"]: r["used_Count"] for r in rows if r["used_Count"]} == USAGE


@pytest.mark.parametrize("customer", DISCOUNTED)
def test_orders_with_discounts(seed, customer):
    rows = reports.orders_with_discounts(seed, customer).orderBy("OrderID").select(
        "OrderID", "TotalOrderPrice", "RestaurantDiscount", "ExchangePointDiscount", "TotalDiscount").collect()
    assert [tuple(r) for r in rows] == DISCOUNTED[customer]


def test_orders_with_discounts_of_all_contains_each_customer(seed):
    rows = reports.orders_with_discounts(seed).select("OrderID", "TotalDiscount").collect()
    found = {tuple(r) for r in rows}
    assert {(r[0], r[4]) for part in DISCOUNTED.values() for r in part} <= found and len(found) == 35


@pytest.mark.parametrize("category", BY_CATEGORY)
def test_orders_by_category(seed, category):
    rows = reports.orders_by_category(seed, category).select("OrderID", "TotalItems", "TotalRevenue").collect()
    assert [tuple(r) for r in rows] == BY_CATEGORY[category]


def test_item_counts(seed):
    rows = reports.item_counts(seed).collect()
    assert {r["categoryID"]: r["total_food"] for r in rows} == {i: COUNTS.get(i, 0) for i in range(1, 28)}


def test_price_levels(seed):
    rows = reports.price_levels(seed).collect()
    assert {level: {r["ID"] for r in rows if r["price_level"] == level} for level in LEVELS} == LEVELS
    one = reports.price_levels(seed, "PizzaHut").collect()
    assert {r["ID"] for r in one} == set(range(19, 29))
    assert reports.price_levels(seed, "Nowhere").collect() == []


def test_price_stats(seed):
    rows = rollups.price_stats(seed["food_item"], seed["category"], seed["restaurant"], "id").collect()
    found = {r["RID"]: (r["avg_price"], r["min_price"], r["max_price"]) for r in rows}
    assert {k: found[k] for k in STATS} == STATS


def test_count_items_ladder(spark, seed):
    asked = [("PizzaHut", 15), ("PizzaHut", 1), ("Nowhere", 1), ("Pizza2", 1), ("PizzaHut", -1), (None, 1),
             ("PizzaHut", 0)]
    rows = reports.count_items(spark.createDataFrame(asked, "restaurant_name string, category_id long"), seed)
    found = {(r[0], r[1]): (r["total_food"], r["error"]) for r in rows.collect()}
    assert found == {
        ("PizzaHut", 15): (5, None), ("PizzaHut", 1): (0, None), ("PizzaHut", 0): (0, None),
        ("Nowhere", 1): (None, "Restaurant does not exist!"),
        ("Pizza2", 1): (None, "Wrong restaurant format name!"),
        (None, 1): (None, "Wrong restaurant format name!"),
        ("PizzaHut", -1): (None, "Category ID must be positive")}


def test_count_items_with_collation(spark, seed):
    asked = spark.createDataFrame([("pho viet nam", 4)], "restaurant_name string, category_id long")
    assert reports.count_items(asked, seed).first()["error"] == "Restaurant does not exist!"
    assert reports.count_items(asked, seed, collation="UNICODE_CI_AI").first()["total_food"] == 1


def test_categorize_items(spark, seed):
    asked = [("PizzaHut", "Pepsi Lemon 320ml"), ("PizzaHut", "a/b"), ("Pizza2", "x"), ("PizzaHut", "item 1"),
             ("Pizza Company", "Pizza Hải Sản Nhiệt Đới")]
    rows = reports.categorize_items(spark.createDataFrame(asked, "restaurant_name string, food_name string"), seed)
    assert {r["food_name"]: (r["price_level"], r["error"]) for r in rows.collect()} == {
        "Pepsi Lemon 320ml": ("Low", None), "a/b": (None, "Invalid food name"),
        "x": (None, "Wrong restaurant format name!"),
        "item 1": (None, "Food item does not exist in the restaurant!"),
        "Pizza Hải Sản Nhiệt Đới": ("High", None)}


def test_loyalty_points(spark, seed):
    pending = spark.createDataFrame([(3, "pending", "delivered"), (1, "pending", "delivered")],
                                    "CID long, old_status string, new_status string")
    assert rollups.points_from_changes(pending).collect() == []
    confirmed = seed["food_order"].filter("order_status = 'confirmed'").select(
        "CID", F.col("order_status").alias("old_status"), F.lit("delivered").alias("new_status"))
    rows = rollups.loyalty_points(seed["customer"], rollups.points_from_changes(confirmed)).collect()
    assert {r["ID"]: r["exchange_points"] for r in rows} == {
        1: 100, 2: 120, 3: 140, 4: 80, 5: 260, 11: 120, 12: 120, 13: 140}


def test_points_of_null_start_at_zero(spark):
    customers = spark.createDataFrame([(1, None), (2, None)], "ID long, exchange_points long")
    earned = spark.createDataFrame([(1, 40)], "CID long, points long")
    rows = rollups.loyalty_points(customers, earned).collect()
    assert {r["ID"]: r["exchange_points"] for r in rows} == {1: 40, 2: None}


def test_menu_and_directories(seed):
    assert reports.menu(seed).count() == 41
    listed = {r["restaurantname"]: (r["page"], r["categories"]) for r in reports.restaurant_categories(seed).collect()}
    assert listed["PizzaHut"] == (0, ["Pizza", "Gà", "Mì", "Salad", "Khoai tây chiên", "Nước uống"])
    assert listed["BotChien"] == (0, ["Đồ Chiên"]) and len(listed) == 10
    directory = reports.category_directory(seed).collect()
    assert [r["ID"] for r in directory] == list(range(1, 28)) and directory[0]["resName"] == "Bánh Mì Huynh Hoa"
    assert reports.customer_directory(seed).count() == 8


def test_long_lists_continue_on_pages(seed):
    paged = reports.restaurant_categories(seed, page_rows=4).filter("restaurantname = 'PizzaHut'")
    rows = paged.orderBy("page").collect()
    assert [r["page"] for r in rows] == [0, 1] and [len(r["categories"]) for r in rows] == [4, 2]


def test_several_discounts_of_one_kind(seed):
    more = dict(seed)
    more["apply_for"] = seed["apply_for"].union(
        seed["apply_for"].sparkSession.createDataFrame([("DIS_SPECIAL", 1)], "DFRcode string, FOID long"))
    row = reports.orders_with_discounts(more, 1, on_multiple="sum").filter("OrderID = 1").first()
    assert row["RestaurantDiscount"] == 25000
    with pytest.raises(Exception, match="more than one discount of one kind on order 1"):
        reports.orders_with_discounts(more, 1).collect()


def test_order_without_lines_keeps_a_null_total(seed):
    fewer = dict(seed)
    fewer["contain"] = seed["contain"].filter("FOID <> 1")
    row = reports.orders_with_discounts(fewer, 1).filter("OrderID = 1").first()
    assert row["TotalOrderPrice"] is None and row["TotalDiscount"] == 5000
    cost = rollups.order_costs(seed["food_order"], fewer["contain"], seed["food_item"]).filter("ID = 1").first()
    assert cost["orderCost"] == 0


def test_further_applications(spark, seed):
    asked = spark.createDataFrame(
        [("DIS_SPECIAL", 5, 1), ("DIS_SPECIAL", 1, 2), ("DIS_PLT10", 2, 3), ("NOPE", 1, 4), ("DIS_HH5", 999, 5)],
        "DFRcode string, FOID long, seq long")
    used = rollups.discount_usage(seed["discount_from_restaurant"], seed["apply_for"])
    rows = admit_applications(asked, used, seed["food_order"], totals(seed), seed["apply_for"]).collect()
    assert {r["seq"]: r["error"] for r in rows} == {
        1: None, 2: None, 3: "duplicate key", 4: "a referenced row does not exist",
        5: "a referenced row does not exist"}


def test_cap_is_strict(spark, seed):
    discounts = spark.createDataFrame([("EQ", 143100), ("OVER", 143101)], "code string, value int")
    asked = spark.createDataFrame([("EQ", 4), ("OVER", 4), ("NOPE", 4)], "DFRcode string, FOID long")
    rows = cross_rules.check_discount_cap(asked, discounts, totals(seed)).collect()
    assert {r["DFRcode"]: r["error"] is None for r in rows} == {"EQ": True, "OVER": False, "NOPE": True}


def test_combined_cap_passes_without_restaurant_discount(spark, seed):
    points = spark.createDataFrame([("BIG", 400000)], "code string, value int")
    asked = spark.createDataFrame([("BIG", 2), ("BIG", 6)], "DFEPcode string, FOID long")
    rows = cross_rules.check_combined_cap(asked, points, seed["apply_for"], seed["discount_from_restaurant"],
                                          totals(seed)).collect()
    assert {r["FOID"]: r["error"] is None for r in rows} == {2: False, 6: True}


def test_line_of_another_restaurant(spark, seed):
    lines = spark.createDataFrame([(1, 4, 1), (1, 1, 1), (99, 1, 1), (1, 99, 1)], "FOID long, FIID long, quantity int")
    rows = cross_rules.check_line_restaurant(lines, seed["food_order"], seed["food_item"], seed["category"]).collect()
    assert {(r[0], r[1]): r["error"] is None for r in rows} == {
        (1, 4): False, (1, 1): True, (99, 1): False, (1, 99): False}
