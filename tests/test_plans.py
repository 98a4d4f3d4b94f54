"""What the plans must and must not hold, and results when nothing is small enough to broadcast."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
from comparison import differences
from tiffin import catalog
from tiffin.operators import skew
from tiffin.operators.cross_rules import check_line_restaurant
from tiffin.plans import reports
from tiffin.sources import testdata

SF = "/root/testdata/sf0.001"
BATCH = [name for name in catalog.QUERIES if not name.startswith("stream_")]
SPREAD = ("price_levels", "categorize_items", "count_items", "resolve_category", "admit_applications",
          "q_discount_cap", "q_combined_cap", "q_exists_collated", "q_duplicates", "add_items", "add_items_by_name",
          "add_accounts", "delete_items", "delete_accounts")


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    """Joins by shuffle only, and every key with more than 20 rows counts as hot."""
    monkeypatch.setattr(skew, "ROWS_PER_SLICE", 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", SPREAD)
def test_hot_keys_without_broadcast(spark, no_broadcast, name):
    assert differences(driver.queries()[name](spark, SF), SF, driver.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, no_broadcast, name):
    text = plan(driver.queries()[name](spark, SF))
    for word in ("CartesianProduct", "NestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert word not in text


def test_scans_are_pruned_and_filters_pushed(spark):
    t = testdata.load_by_priority(spark, SF)
    text = plan(reports.orders_with_discounts(t))
    lines = next(l for l in text.splitlines() if "l_orderkey" in l and "FileScan" in l)
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>" in lines
    assert "In(o_orderpriority" in text


def test_lines_are_combined_before_the_shuffle_by_order(spark):
    text = plan(driver.queries()["order_totals"](spark, SF))
    assert "partial_sum(amount" in text


def test_hot_order_is_split_at_run_time(spark):
    """A third of the lines belong to one order: the plain joins leave the split to AQE."""
    lines = (spark.range(60_000, numPartitions=4)
             .select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("FOID"),
                     (F.col("id") % 200).alias("FIID"), F.hash("id").alias("quantity")))
    orders = spark.range(5000).select(F.col("id").alias("ID"), (F.col("id") % 25 + 1).alias("RID"))
    t = testdata.load(spark, SF)
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        judged = check_line_restaurant(lines, orders, t["food_item"], t["category"])
        assert len(judged.collect()) == 60_000
        assert "skew=true" in plan(judged)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
