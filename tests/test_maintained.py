"""Stored roll-ups with changes added equal the roll-ups of the changed tables."""

from pyspark.sql import functions as F

from tiffin.operators import maintained
from tiffin.plans import changes


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def totals(lines, items):
    return maintained.stored_totals(lines, items).select("FOID", "total", "lines")


def test_deleted_moved_and_added_lines(spark, seed):
    items, lines = seed["food_item"], seed["contain"]
    stored = totals(lines, items)
    done = changes.delete_items(seed, spark.createDataFrame([(1, 5), (2, 17), (3, 999)], "seq long, ID long"))
    orders = changes.delete_orders(seed, spark.createDataFrame([(1, 3), (2, 4)], "seq long, ID long"))
    now = items.withColumn("price", F.when(F.col("ID") % 2 == 0, F.col("price") * 2).otherwise(F.col("price")))
    removed = done.cascade.deleted["contain"].unionByName(orders.cascade.deleted["contain"])
    added = spark.createDataFrame([(7, 2, 3), (9000, 4, 1), (9000, 6, 2)], lines.schema)
    moved = maintained.total_changes(seed, removed=removed, added=added, items=now)
    kept = lines.join(removed, ["FOID", "FIID"], "left_anti").unionByName(added)
    assert bag(maintained.merged(stored, moved, "FOID", ["total", "lines"], "lines")) == bag(totals(kept, now))


def test_each_kind_of_change_alone(spark, seed):
    items, lines = seed["food_item"], seed["contain"]
    stored = totals(lines, items)
    none = maintained.total_changes(seed)
    assert bag(maintained.merged(stored, none, "FOID", ["total", "lines"], "lines")) == bag(stored)
    everything = maintained.total_changes(seed, removed=lines)
    assert maintained.merged(stored, everything, "FOID", ["total", "lines"], "lines").count() == 0
    one = items.filter("ID = 5").withColumn("price", F.col("price") + 1)
    moved = maintained.total_changes(seed, items=one)
    now = items.filter("ID <> 5").unionByName(one)
    assert bag(maintained.merged(stored, moved, "FOID", ["total", "lines"], "lines")) == bag(totals(lines, now))


def test_usage(spark, seed):
    applied = seed["apply_for"].select("DFRcode", "FOID")
    count = lambda df: df.groupBy("DFRcode").agg(F.count(F.lit(1)).alias("n"))
    gone = applied.filter("FOID % 2 = 0")
    new = spark.createDataFrame([("NEW", 1), ("NEW", 2)], applied.schema)
    out = maintained.merged(count(applied), maintained.usage_changes(gone, new), "DFRcode", ["n"], "n")
    assert bag(out) == bag(count(applied.subtract(gone).unionByName(new)))


def test_removed_keys_and_lines_are_staged_once(spark, seed):
    """``stage`` gets the removed keys and their lines, so that they are not computed for each reader."""
    staged = []
    removed = seed["contain"].filter("FOID % 3 = 0").select("FOID", "FIID")
    moved = maintained.total_changes(seed, removed=removed.unionByName(removed), items=seed["food_item"].withColumn(
        "price", F.col("price") + 1), stage=lambda df: staged.append(df) or df)
    assert [sorted(df.columns) for df in staged[:2]] == [["FIID", "FOID"], ["FIID", "FOID", "quantity"]]
    assert staged[0].count() == staged[1].count() == removed.count()
    now = seed["food_item"].withColumn("price", F.col("price") + 1)
    out = maintained.merged(totals(seed["contain"], seed["food_item"]), moved, "FOID", ["total", "lines"], "lines")
    assert bag(out) == bag(totals(seed["contain"].filter("FOID % 3 <> 0"), now))
