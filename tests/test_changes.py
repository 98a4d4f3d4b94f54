"""Change sets against the same requests taken one after another in Python."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiffin.functions import rules
from tiffin.operators import quality
from tiffin.operators.admission import admit_applications
from tiffin.operators.rollups import order_totals
from tiffin.operators.sequential import first_come
from tiffin.plans import cascade, changes
from tiffin.session import durable

few = settings(max_examples=4, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def errors(rejects):
    return {r["seq"]: r["error"] for r in rejects.collect()}


def test_add_items_ladder(spark, seed):
    asked = spark.createDataFrame(
        [(1, "", 0, 30), (2, "x", 0, 30), (3, "x", 5, 30), (4, "x", 5, 2), (5, "x", 5, 2), (6, "item 1", 68000, 1),
         (7, " ", 5, 2), (8, None, 5, 2), (9, "z", None, 2)],
        "seq long, name string, price int, categoryID long").withColumn("image", F.lit(""))
    plain = changes.add_items(seed["food_item"], seed["category"], asked)
    assert errors(plain.rejects) == {
        1: rules.MSG_ITEM_BLANK, 2: rules.MSG_PRICE, 3: rules.MSG_NEW_CATEGORY, 8: rules.MSG_REQUIRED,
        9: rules.MSG_REQUIRED}
    added = {r["ID"]: r["name"] for r in plain.table.filter("ID > 41").collect()}
    assert added == {42: "x", 43: "x", 44: "item 1", 45: " "}
    strict = changes.add_items(seed["food_item"], seed["category"], asked, refuse_duplicates=True)
    refused = errors(strict.rejects)
    assert refused[5] == refused[6] == rules.MSG_DUPLICATE_ITEM and 4 not in refused


def test_add_items_by_name(spark, seed):
    asked = spark.createDataFrame(
        [(1, "x", 5, "PizzaHut", "Pizza"), (2, "x", 5, "PizzaHut", "Sushi"), (3, "x", 5, "PizzaHut", "Pizza"),
         (4, "", 5, "BotChien", "Đồ Chiên")],
        "seq long, name string, price int, restaurant string, category string")
    change = changes.add_items_by_name(seed["food_item"], seed["category"], seed["restaurant"], asked)
    assert errors(change.rejects) == {
        2: rules.MSG_CATEGORY_NAME, 3: rules.MSG_DUPLICATE_ITEM, 4: rules.MSG_ITEM_BLANK}
    row = change.table.filter("ID = 42").first()
    assert (row["name"], row["categoryID"], row["image"]) == ("x", 15, "")


def test_update_items(spark, seed):
    asked = spark.createDataFrame(
        [(1, 999, "a", 5, 1), (2, 1, "a", 0, 1), (3, 1, "a", 5, 999), (4, 1, "", 5, 6), (5, 1, "last", 7, 6),
         (6, 1, "refused", 0, 6)],
        "seq long, ID long, name string, price int, categoryID long").withColumn("image", F.lit(""))
    change = changes.update_items(seed["food_item"], seed["category"], asked)
    assert errors(change.rejects) == {
        1: rules.MSG_UPDATE_ITEM, 2: rules.MSG_PRICE, 3: rules.MSG_CATEGORY, 6: rules.MSG_PRICE}
    row = change.table.filter("ID = 1").first()
    assert (row["name"], row["price"], row["categoryID"]) == ("last", 7, 6) and change.table.count() == 41


def test_update_items_by_name(spark, seed):
    asked = spark.createDataFrame([(1, 2, "y", 9, "PizzaHut", "Gà"), (2, 2, "y", 9, "Nowhere", "Gà")],
                                  "seq long, ID long, name string, price int, restaurant string, category string")
    change = changes.update_items_by_name(seed["food_item"], seed["category"], seed["restaurant"], asked)
    assert errors(change.rejects) == {2: rules.MSG_CATEGORY_NAME}
    assert change.table.filter("ID = 2").first()["categoryID"] == 16


def test_delete_items_and_their_lines(spark, seed):
    asked = spark.createDataFrame([(1, 100), (2, 7), (3, 7)], "seq long, ID long")
    done = changes.delete_items(seed, asked)
    assert errors(done.rejects) == {1: rules.MSG_DELETE_ITEM, 3: rules.MSG_DELETE_ITEM}
    assert done.cascade.tables["food_item"].count() == 40
    assert sorted(r["FOID"] for r in done.cascade.deleted["contain"].collect()) == [13, 16]
    assert done.cascade.tables["contain"].count() == 60


def test_delete_orders(spark, seed):
    done = changes.delete_orders(seed, spark.createDataFrame([(1, 2), (2, 77)], "seq long, ID long"))
    assert errors(done.rejects) == {2: rules.MSG_ORDER}
    counts = {r["table"]: r["deleted"] for r in done.cascade.counts().collect()}
    assert counts == {"food_order": 1, "contain": 1, "apply_for": 1, "discount_point_apply_for": 1}


def test_accounts_taken_within_the_batch(spark, seed):
    asked = spark.createDataFrame(
        [(1, "x", "short"), (2, "x", "longenough"), (3, "x", "longenough2"), (4, "user1", "longenough"),
         (5, "x", "short"), (6, "y", None)], "seq long, username string, password string")
    change = changes.add_accounts(seed["account"], asked)
    assert errors(change.rejects) == {
        1: rules.MSG_PASSWORD, 3: rules.MSG_USERNAME_TAKEN, 4: rules.MSG_USERNAME_TAKEN,
        5: rules.MSG_USERNAME_TAKEN, 6: rules.MSG_REQUIRED}
    assert [r["username"] for r in change.table.filter("ID = 19").collect()] == ["x"]


def test_add_customers(spark, seed):
    accounts = seed["account"].unionByName(spark.createDataFrame(
        [(i, f"new{i}", "password") for i in range(50, 58)], "ID long, username string, password string"))
    stored = seed["customer"].filter("ID = 1").first()
    rows = [
        (1, "nobody", "a@b.vn", "0900000050", "c50"), (2, "new50", "a@b-c.com", "0900000050", "c50"),
        (3, "new50", "a@b.vn", "1900000050", "c50"), (4, "new50", None, "0900000050", "c50"),
        (5, "new50", "a@b.vn", "0900000099", "c99"),           # account taken by 4
        (6, "new51", "a@b.vn", "0900000050", "c51"),           # phone of 4
        (7, "new52", "a@b.vn", "0900000052", "c51"),           # free: 6 was refused
        (8, "new53", "a@b.vn", stored["phone_number"], "c53"),  # phone stored
        (9, "new54", "a@b.vn", "0900000054", None)]
    asked = (spark.createDataFrame(rows, "seq long, username string, email string, phone_number string, card_number string")
             .withColumns({"name": F.lit("n"), "address": F.lit("s"), "birthdate": F.lit("2000-01-01").cast("date"),
                           "bank_name": F.lit(None).cast("string")}))
    change = changes.add_customers(seed["customer"], accounts, asked)
    assert errors(change.rejects) == {
        1: rules.MSG_NO_USERNAME, 2: rules.MSG_EMAIL, 3: rules.MSG_PHONE, 5: rules.MSG_KEY, 6: rules.MSG_KEY,
        8: rules.MSG_KEY, 9: rules.MSG_REQUIRED}
    added = {r["ID"]: r["exchange_points"] for r in change.table.filter("ID >= 50").collect()}
    assert added == {50: 0, 52: 0}


def plain_first_come(rows):
    """Row after row: the number of the first key already taken, None if accepted."""
    taken, out = set(), {}
    for seq, *keys in sorted(rows):
        claims = [(i, k) for i, k in enumerate(keys) if k is not None]
        hit = next((i for i, k in claims if (i, k) in taken), None)
        if hit is None:
            taken.update(claims)
        out[seq] = hit
    return out


@pytest.mark.parametrize("fold_rows", [10_000, 3])
def test_first_come_by_groups(spark, fold_rows):
    rng = random.Random(fold_rows)
    rows = [(i, rng.randrange(60), rng.choice([None, rng.randrange(60)])) for i in range(70)] + [(100 + i, 500, i) for i in range(40)]
    df = spark.createDataFrame(rows, "seq long, a long, b long")
    judged = first_come(df, df.limit(0).drop("seq"), [["a"], ["b"]], names=["a", "b"], fold_rows=fold_rows)
    names = {None: None, 0: "a", 1: "b"}
    assert {r.seq: r.conflict for r in judged.collect()} == {s: names[h] for s, h in plain_first_come(rows).items()}


def test_a_chain_needs_few_jobs(spark):
    """Each of 1,000 requests shares a key with the next one, in shuffled order."""
    order = list(range(1000))
    random.Random(1).shuffle(order)
    rows = [(seq, (n + 1) // 2, n // 2) for seq, n in enumerate(order)]
    df = spark.createDataFrame(rows, "seq long, a long, b long")
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("chain", "chain")
    try:
        judged = first_come(df, df.limit(0).drop("seq"), [["a"], ["b"]], names=["a", "b"])
        found = {r.seq: r.conflict for r in judged.collect()}
        jobs = len(tracker.getJobIdsForGroup("chain"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    names = {None: None, 0: "a", 1: "b"}
    assert found == {s: names[h] for s, h in plain_first_come(rows).items()}
    assert jobs < 250


@few
@given(st.lists(st.tuples(st.integers(0, 5), st.one_of(st.none(), st.integers(0, 5)), st.integers(0, 5)),
                min_size=1, max_size=25))
def test_first_come_is_row_after_row(spark, keys):
    rows = [(i, *k) for i, k in enumerate(keys)]
    ddl = "seq long, a long, b long, c long"
    stored = [(100, 0, 3, 9)]
    taken = [{0}, {3}, {9}]
    expected = {}
    for seq, *values in rows:
        expected[seq] = all(v is None or v not in held for v, held in zip(values, taken))
        if expected[seq]:
            for v, held in zip(values, taken):
                held.add(v)
    judged = first_come(spark.createDataFrame(rows, ddl), spark.createDataFrame(stored, ddl), [["a"], ["b"], ["c"]])
    assert {r["seq"]: r["conflict"] is None for r in judged.collect()} == expected


@pytest.mark.parametrize("round_", range(2))
def test_admission_is_row_after_row(spark, seed, round_):
    rng = random.Random(round_)
    limits = {"A": 3, "B": 0, "C": None, "D": 40}
    values = {"A": 10, "B": 10, "C": 90000, "D": 60000}
    discounts = spark.createDataFrame([(c, limits[c], 0, values[c]) for c in limits],
                                      "code string, usageLimit long, used_Count long, value int")
    asked = [(rng.choice([*limits, "NOPE"]), rng.randint(1, 40), seq) for seq in range(160)]
    totals = {r["FOID"]: r["total"] for r in order_totals(seed["contain"], seed["food_item"]).collect()}
    stored = [("A", 1), ("C", 2), ("NOPE", 3)]
    used, pairs, expected = dict.fromkeys(limits, 0), set(stored), {}
    for code, order, seq in asked:
        if code in values and order in totals and values[code] * 100 > totals[order] * 30:
            expected[seq] = rules.MSG_DISCOUNT_CAP
        elif (code, order) in pairs:
            expected[seq] = rules.MSG_KEY
        elif code not in limits or order > 38:
            expected[seq] = rules.MSG_REFERENCE
        elif limits[code] is not None and used[code] >= limits[code]:
            expected[seq] = rules.MSG_QUOTA
        else:
            expected[seq] = None
            used[code] += 1
            pairs.add((code, order))
    assert {*expected.values()} == {None, rules.MSG_DISCOUNT_CAP, rules.MSG_KEY, rules.MSG_REFERENCE, rules.MSG_QUOTA}
    existing = spark.createDataFrame(stored, "DFRcode string, FOID long")
    total_df = spark.createDataFrame(list(totals.items()), "FOID long, total long")
    for stage in (lambda df: df, durable):
        judged = admit_applications(spark.createDataFrame(asked, "DFRcode string, FOID long, seq long"), discounts,
                                    seed["food_order"], total_df, existing, stage=stage)
        assert {r["seq"]: r["error"] for r in judged.collect()} == expected


def test_delete_customer_account(spark, seed):
    asked = spark.createDataFrame([(1, "user1", "password1"), (2, "user2", "wrong"), (3, "user1", "password1")],
                                  "seq long, username string, password string")
    done = changes.delete_accounts(seed, asked)
    assert errors(done.rejects) == {2: rules.MSG_LOGIN, 3: rules.MSG_LOGIN}
    gone = {name: sorted(tuple(r) for r in rows.collect()) for name, rows in done.cascade.deleted.items()}
    assert gone["food_order"] == [(i,) for i in (1, 4, 10, 27, 28, 29)]
    assert gone["customer"] == [(1,)] and gone["use"] == [(1, "DIS_HH5")]
    assert gone["discount_from_exchange_point"] == [("EXC_NAM20",)] and gone["restaurant"] == []
    left = dict(seed) | done.cascade.tables
    assert quality.check_references(left, left).collect() == []


def test_restaurant_with_discounts_stays(spark, seed):
    asked = spark.createDataFrame([(1, "user6", "password6"), (2, "user2", "password2")],
                                  "seq long, username string, password string")
    done = changes.delete_accounts(seed, asked, stage=durable)
    assert errors(done.rejects) == {1: rules.MSG_RESTRICTED}
    assert done.cascade.tables["restaurant"].count() == 10
    assert done.cascade.tables["account"].count() == 17
    free = dict(seed) | {"discount_from_restaurant": seed["discount_from_restaurant"].filter("RID <> 6")}
    gone = cascade.cascade_delete(free, "restaurant", spark.createDataFrame([(6,)], "ID long"))
    assert gone.blocked.count() == 0 and gone.tables["restaurant"].count() == 9
    assert gone.deleted["category"].count() == 9


def test_cascade_reaches_children_after_parents():
    order = cascade.reach("account")
    assert set(order) == {"account", "customer", "restaurant", "discount_from_exchange_point", "category", "food_item",
                          "food_order", "use", "contain", "apply_for", "discount_point_apply_for"}
    for parent, child in (("customer", "food_order"), ("category", "food_item"), ("food_item", "contain"),
                          ("food_order", "contain"), ("discount_from_exchange_point", "discount_point_apply_for")):
        assert order.index(parent) < order.index(child)


def test_retire_discounts(spark, seed):
    used = seed["discount_from_restaurant"].withColumn(
        "used_Count", F.when(F.col("code").isin("DIS_PLT10", "DIS_HT5"), F.col("usageLimit") - 1).otherwise(F.lit(0)))
    tables = dict(seed) | {"discount_from_restaurant": used}
    result = changes.retire_discounts(tables)
    assert [r["code"] for r in result.deleted["discount_from_restaurant"].collect()] == ["DIS_PLT10"]
    assert result.deleted["apply_for"].count() == 8
    none = changes.retire_discounts(tables, spark.createDataFrame([(1,)], "FOID long"))
    assert none.deleted["discount_from_restaurant"].count() == 0
