"""One bad row per rule."""

import pytest
from pyspark.sql import functions as F

from tiffin.contracts import TABLES
from tiffin.functions import rules, text
from tiffin.operators import quality
from tiffin.sources import loading
from tiffin.sources.tables import lookup, open_latest, publish


def broken(df):
    return sorted((r["rule"], r["key"]) for r in df.collect())


def verdict(spark, violation, value, type_="string"):
    df = spark.createDataFrame([(value,)], f"v {type_}")
    return df.select(violation(F.col("v")).alias("bad")).first()["bad"]


@pytest.mark.parametrize("violation, value, bad", [
    (rules.bad_email, "a@b.c", True), (rules.bad_email, "a+b@x.vn", False), (rules.bad_email, "a@b-c.com", True),
    (rules.bad_email, None, None), (rules.bad_phone, "0913133811", False), (rules.bad_phone, "1900633606", True),
    (rules.bad_phone, "091313381", True), (rules.short_password, "mậtkh", True),
    (rules.short_password, "mậtkhẩ", False), (rules.empty, "", True), (rules.empty, " ", False),
    (rules.bad_restaurant_name, "Phở Việt Nam", False), (rules.bad_restaurant_name, "Pizza2", True),
    (rules.bad_item_name, "Ba#1", False), (rules.bad_item_name, "a/b", True),
    (rules.bad_item_name, "Cánh gà giòn Xốt Cay (4 miếng)", False)])
def test_formats(spark, violation, value, bad):
    assert verdict(spark, violation, value) is bad


def test_order_rules(spark, seed):
    good = seed["food_order"].filter("ID = 1")
    bad = (good.withColumns({"order_status": F.lit("shipped"), "rating": F.lit(6), "delivery_fee": F.lit(-1),
                             "ship_status": F.lit(None).cast("string")})
           .unionByName(good.withColumns({"ID": F.lit(2).cast("long"), "rating": F.lit(None).cast("int")})))
    found = quality.violations_by_row(bad, "food_order", quality.row_rules(TABLES["food_order"]))
    assert broken(found) == [("delivery_fee_not_negative", "1"), ("domain_order_status", "1"),
                             ("rating_one_to_five", "1")]


def test_discount_rules(spark, seed):
    base = seed["discount_from_restaurant"].filter("code = 'DIS_HH5'")

    def variant(code, **columns):
        return base.withColumns({"code": F.lit(code)} | {k: F.expr(v) for k, v in columns.items()})

    rows = (variant("over", usageLimit="10L", used_Count="11L")
            .unionByName(variant("none", usageLimit="CAST(NULL AS BIGINT)"))
            .unionByName(variant("late", end_date="DATE'2024-12-09'"))
            .unionByName(variant("free", value="0")))
    assert broken(quality.check_expr(rows, "discount_from_restaurant")) == [
        ("usage_within_limit", "over"), ("valid_seven_days", "late"), ("value_positive", "free")]


def test_keys_and_references(spark, seed):
    lines = seed["contain"].unionByName(
        spark.createDataFrame([(3, 1, 2), (99, 1, 1)], "FOID long, FIID long, quantity int"))
    changed = dict(seed) | {"contain": lines}
    assert broken(quality.check_table(changed, "contain")) == [("foreign_key_FOID", "99|1"), ("key_FOID_FIID", "3|1")]


def test_missing_columns_are_listed_together(spark):
    rows = spark.createDataFrame([(1, None, None)], "ID long, username string, password string")
    found = quality.check_not_null(rows, "account").first()
    assert (found["key"], found["detail"]) == ("1", "username,password")


def test_split_valid_names_the_first_rule(spark):
    rows = spark.createDataFrame([(1, "n", 0, 1), (2, None, 0, 1), (3, "n", 5, 1)],
                                 "ID long, name string, price int, categoryID long").withColumn("image", F.lit(""))
    accepted, rejected = quality.split_valid(rows, "food_item")
    assert [r["ID"] for r in accepted.collect()] == [3]
    assert {r["ID"]: r["error"] for r in rejected.collect()} == {1: "price_positive", 2: "not_null"}


def test_exists_in_with_null_and_repeats(spark):
    asked = spark.createDataFrame([(1, "x"), (2, None), (3, "y"), (4, "x")], "seq long, k string")
    held = spark.createDataFrame([("x",), ("x",), (None,)], "k string")
    found = quality.exists_in(asked, held, {"k": "k"})
    assert {r["seq"]: r["found"] for r in found.collect()} == {1: True, 2: False, 3: False, 4: True}


def test_defaults_fill_omitted_columns_only(spark):
    rows = spark.createDataFrame([(1, None)], "ID long, order_status string")
    filled = loading.apply_defaults(rows, "food_order").first()
    assert filled["order_status"] is None and filled["orderCost"] == 0
    assert loading.apply_defaults(rows.drop("order_status"), "food_order").first()["order_status"] == "pending"


def test_load_rows(spark, seed):
    rows = spark.createDataFrame(
        [(1, "new", 1000, 3), (2, "free", 0, 3), (3, "lost", 1000, 99), (4, None, 10, 3), (5, "next", 2000, 1)],
        "seq long, name string, price int, categoryID long")
    table, rejects = loading.load_rows(seed, "food_item", rows)
    added = {r["ID"]: r["name"] for r in table.filter("ID > 41").collect()}
    assert added == {42: "new", 46: "next"}
    assert {r["seq"]: r["error"] for r in rejects.collect()} == {
        2: "price_positive", 3: "foreign_key_categoryID", 4: "not_null"}
    with pytest.raises(loading.LoadRefused, match="food_item: "):
        loading.load_rows(seed, "food_item", rows, strict=True)
    fine = rows.filter("seq IN (1, 5)")
    assert loading.load_rows(seed, "food_item", fine, strict=True)[0].count() == 43


def test_a_strict_load_is_judged_while_its_rows_are_written(spark, seed, tmp_path):
    writes = []

    def stage(df):
        path = f"{tmp_path}/{len(writes)}"
        df.write.parquet(path)
        writes.append(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = spark.createDataFrame(
        [(1, "a", 0, 3), (2, "b", 5, 99), (3, "c", -1, 99), (4, "d", 9, 3)], "seq long, name string, price int, categoryID long")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("strict", "strict")
    try:
        with pytest.raises(loading.LoadRefused) as told:
            loading.load_rows(seed, "food_item", rows, strict=True, stage=stage)
        during = set(jobs.getJobIdsForGroup("strict"))
        spark.sparkContext.setJobGroup("again", "again")
        spark.read.parquet(writes[0]).count()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert told.value.refused == {"price_positive": 2, "foreign_key_categoryID": 1}
    assert len(writes) == 1 and during  # nothing ran after the one write


def test_load_rows_with_a_given_key(spark, seed):
    rows = spark.createDataFrame([(1, 3, 1, 2), (2, 3, 5, 2), (3, 3, 5, 9), (4, 99, 5, 9)],
                                 "seq long, FOID long, FIID long, quantity int")
    table, rejects = loading.load_rows(seed, "contain", rows)
    assert table.count() == 63
    assert {r["seq"]: r["error"] for r in rejects.collect()} == {
        1: "key_FOID_FIID", 3: "key_FOID_FIID", 4: "foreign_key_FOID"}
    with pytest.raises(loading.LoadRefused) as told:
        loading.load_rows(seed, "contain", rows.filter("seq < 4"), strict=True)
    assert told.value.refused == {"key_FOID_FIID": 2}


def test_csv_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,RID\nBánh,6\n,7\n", encoding="utf-8")
    rows = loading.read_csv_rows(spark, str(tmp_path), "category", ["name", "RID"])
    assert sorted((r["name"] or "", r["RID"]) for r in rows.collect()) == [("", 7), ("Bánh", 6)]


def test_publish_and_open_latest(spark, seed, tmp_path):
    root = str(tmp_path)
    publish(spark, {"category": seed["category"], "use": seed["use"]}, root, 1)
    publish(spark, {"use": seed["use"].limit(0)}, root, 2)
    now = open_latest(spark, root)
    assert now["category"].count() == 27 and now["use"].count() == 0


def test_clustered_tables_are_sorted_by_key(spark, seed, tmp_path):
    publish(spark, {"contain": seed["contain"]}, str(tmp_path), 1, clustered=True)
    table = open_latest(spark, str(tmp_path))["contain"]
    assert table.count() == 62
    parts = table.withColumn("part", F.spark_partition_id()).collect()
    for part in {r["part"] for r in parts}:
        rows = [(r["FOID"], r["FIID"]) for r in parts if r["part"] == part]
        assert rows and rows == sorted(rows)


def rows_scanned(df):
    """Rows and the number of rows that the scan handed on."""
    rows = df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return rows, leaf.metrics().apply("numOutputRows").value()


def test_a_lookup_skips_row_groups_of_an_unsorted_table(spark, tmp_path):
    n = 200_000
    codes = spark.range(n).select(
        F.concat(F.lit("DIS_"), F.md5(F.col("id").cast("string"))).alias("DFRcode"), F.xxhash64("id").alias("FOID")).repartition(1)
    publish(spark, {"apply_for": codes}, str(tmp_path), 1, row_group_bytes=1 << 20)
    table = open_latest(spark, str(tmp_path))["apply_for"]
    for key, value in (("DFRcode", "md5('777')"), ("FOID", "xxhash64(4321L)")):
        wanted = spark.sql(f"SELECT {value} AS v").first().v
        rows, read = rows_scanned(lookup(table, key, f"DIS_{wanted}" if key == "DFRcode" else wanted))
        assert len(rows) == 1 and 0 < read <= n / 2
    rows, read = rows_scanned(lookup(table, "DFRcode", ["DIS_no such code", "DIS_nor this"]))
    assert rows == [] and read <= n / 2


def test_references_are_told_by_value(spark, seed):
    """A value that many rows name, an empty text, a null, and two columns of one table."""
    use = spark.createDataFrame([(1, ""), (1, "gone"), (9999, "gone"), (None, "gone"), (9999, None)] + [(8888, "x")] * 300, "CID long, DFRcode string")
    tables = {"customer": seed["customer"], "discount_from_restaurant": seed["discount_from_restaurant"], "use": use}
    stored = {r.ID for r in seed["customer"].collect()}
    found = quality.check_references(tables, ["use"]).groupBy("rule", "key", "detail").count().collect()
    expected = {}
    for cid, code in [(r.CID, r.DFRcode) for r in use.collect()]:
        key = "|".join("NULL" if v is None else str(v) for v in (cid, code))
        if code is not None:
            expected["foreign_key_DFRcode", key, code] = expected.get(("foreign_key_DFRcode", key, code), 0) + 1
        if cid is not None and cid not in stored:
            expected["foreign_key_CID", key, str(cid)] = expected.get(("foreign_key_CID", key, str(cid)), 0) + 1
    assert {(r.rule, r.key, r.detail): r["count"] for r in found} == expected
    assert quality.check_references({"use": use}, ["use"]) is None


def test_values_are_found_in_one_read_of_a_child(spark, seed):
    seen = []

    def stage(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return df

    assert quality.check_references(seed, list(seed), stage).collect() == []
    scans = [line for line in seen[0].splitlines() if "Relation" in line and "FDID" in line]
    assert len(scans) <= 2  # food_order as a child and as a parent


def test_lookup(spark, seed):
    assert lookup(seed["food_item"], "ID", 7).count() == 1
    assert lookup(seed["food_item"], "ID", [7, 8, 99]).count() == 2
    assert lookup(seed["food_item"], "ID", spark.createDataFrame([(7,), (7,)], "wanted long")).count() == 1
    plan = lookup(seed["food_item"], "ID", 7)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(ID,7)" in plan


def test_texts(spark):
    row = spark.sql("SELECT TIMESTAMP'2024-12-01 14:30:00' AS at, 68000 AS p, 0 AS r").select(
        text.format_ts(F.col("at")), text.format_vnd(F.col("p")), text.display_rating(F.col("r"))).first()
    assert tuple(row) == ("2024-12-01 14:30:00", "68.000\u00a0₫", 5)
    text.register(spark)
    row = spark.sql("SELECT format_vnd(1234567), is_email('a+b@x.vn'), is_phone('123'), is_item_name('a/b'), "
                    "is_restaurant_name('Phở'), is_password('short'), display_rating(NULL)").first()
    assert tuple(row) == ("1.234.567\u00a0₫", True, False, False, True, False, 5)
