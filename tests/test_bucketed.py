"""Tables kept in buckets: changes rewrite the buckets of their keys and no others."""

import glob
import os

from pyspark.sql import functions as F

from tiffin.plans import bucketed, changes
from tiffin.session import durable


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def files(root):
    return {os.path.relpath(f, root) for f in glob.glob(f"{root}/**/*.parquet", recursive=True) if "/lists/" not in f}


def test_deletion_rewrites_its_buckets_only(spark, seed, tmp_path):
    kept = bucketed.keep_tables(spark, seed, str(tmp_path), ["food_item", "contain"], 16)
    before = {name: files(f"{tmp_path}/{name}") for name in kept}
    done = changes.delete_items(seed, spark.createDataFrame([(1, 5)], "seq long, ID long"), stage=durable)
    touched = bucketed.apply_deletion(kept, done.cascade, 0)
    assert len(touched["food_item"]) == 1
    for name in kept:
        unread = {f for f in before[name] if int(f.split("_bucket=")[1].split("/")[0]) not in touched[name]}
        live = {os.path.relpath(f.removeprefix("file://"), f"{tmp_path}/{name}") for f in kept[name].read_all(spark).inputFiles()}
        assert unread and unread <= live  # under the same names
    left = bucketed.read_tables(spark, kept)
    assert bag(left["food_item"]) == bag(done.cascade.tables["food_item"])
    assert bag(left["contain"]) == bag(done.cascade.tables["contain"])
    assert bag(bucketed.read_tables(spark, kept, -1)["contain"]) == bag(seed["contain"])


def test_update_and_addition(spark, seed, tmp_path):
    kept = bucketed.keep_tables(spark, seed, str(tmp_path), ["food_item"], 16)
    after = seed["food_item"].withColumn("price", F.when(F.col("ID") == 7, 1).otherwise(F.col("price"))).unionByName(
        seed["food_item"].filter("ID = 8").withColumn("ID", F.lit(99).cast("long")))
    moved = durable(bucketed.changed_rows(seed["food_item"], after, "food_item"))
    assert sorted(r.ID for r in moved.collect()) == [7, 99]
    for _ in range(2):  # run again under its version
        bucketed.upsert_rows(kept["food_item"], "food_item", moved, 0)
    assert bag(bucketed.read_tables(spark, kept)["food_item"]) == bag(after)
