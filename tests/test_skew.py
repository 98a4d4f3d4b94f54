"""The balanced operators give what the plain ones give, whatever the slice and block sizes."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tiffin.operators import skew

few = settings(max_examples=5, deadline=None,
               suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_spread_join_equals_plain_join(spark):
    rng = random.Random(1)
    left = [(i, "hot" if i % 3 else rng.choice(["a", "b", "c", None])) for i in range(300)]
    left_df = spark.createDataFrame(left, "seq long, k string")
    right_df = spark.createDataFrame([("hot", 1), ("a", 2), ("x", 3)], "k string, v long")
    for how in ("left", "inner", "left_semi", "left_anti"):
        plain = left_df.join(right_df, "k", how)
        spread = skew.spread_join(left_df, right_df, ["k"], how, ["seq"], rows_per_slice=10)
        assert rows(spread.select(*plain.columns).fillna("-")) == rows(plain.fillna("-"))


def test_spread_join_cuts_the_hot_key(spark):
    left = spark.range(1000).select(F.col("id").alias("seq"), F.lit("hot").alias("k"))
    right = spark.createDataFrame([("hot", 1)], "k string, v long").hint("merge")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        joined = skew.spread_join(left, right, ["k"], "left", ["seq"], rows_per_slice=50)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sum(sizes) == 1000 and len(sizes) > 1


@few
@given(values=st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(-2**50, 2**50)), min_size=1, max_size=60,
                       unique_by=lambda v: v[1]))
def test_distributed_rank(spark, values):
    df = spark.createDataFrame(values, "k string, v long")
    per_key = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy("v")).cast("long"))
    assert rows(skew.distributed_rank(df, "v", ["k"]).select("k", "v", "rank")) == rows(per_key)
    whole = [(v, i) for i, v in enumerate(sorted(v for _, v in values), 1)]
    assert rows(skew.distributed_rank(df, "v").select("v", "rank")) == whole


def test_distributed_rank_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 5), ("a", None), (None, 1)], "k string, v long")
    ranked = {(r["k"], r["v"]): r["rank"] for r in skew.distributed_rank(df, "v", ["k"]).collect()}
    assert ranked == {("a", None): 1, ("a", 5): 2, (None, 1): None}


def test_distributed_rank_crosses_blocks(spark):
    values = [(i * (2**19),) for i in range(-40, 40)] + [(2**43 + i,) for i in range(20)]
    df = spark.createDataFrame(values, "v long")
    counted = skew.distributed_rank(df, "v", counting=F.col("v") % 3 == 0)
    running, expected = 0, []
    for (v,) in sorted(values):
        running += v % 3 == 0
        expected.append((v, running))
    assert rows(counted.select("v", "rank")) == expected


@few
@given(st.lists(st.tuples(st.sampled_from([1, 2]), st.integers(0, 30), st.sampled_from(["view", "buy", "x"])),
                min_size=1, max_size=60))
def test_transition_counts(spark, history):
    numbered = [(e, f"2024-01-01 {h // 4:02d}:{h % 4 * 15:02d}:00", i, s) for i, (e, h, s) in enumerate(history)]
    df = (spark.createDataFrame(numbered, "e long, at string, seq long, s string")
          .withColumn("at", F.col("at").cast("timestamp")))
    expected = {}
    for entity in (1, 2):
        states = [s for _, _, s in sorted((at, i, s) for e, at, i, s in numbered if e == entity)]
        n = sum(a == "view" and b == "buy" for a, b in zip(states, states[1:]))
        if n:
            expected[entity] = n
    for bucket in ("hour", "day"):
        counted = skew.transition_counts(df, ["e"], "s", "at", "seq", "view", "buy", bucket)
        assert {r["e"]: r["n"] for r in counted.collect()} == expected


@pytest.mark.parametrize("moments", [1, 3, 4000])
def test_a_long_hour_is_cut_into_blocks(spark, moments):
    """A third of all rows are one entity's in one hour, at few moments or at many."""
    rng = random.Random(moments)
    rows = [(1, 1_700_000_000_000_000 + rng.randrange(moments), i, rng.choice(["view", "buy", "other"])) for i in range(3000)]
    rows += [(e, 1_700_000_000_000_000 + rng.randrange(10**11), i, rng.choice(["view", "buy"])) for i, e in enumerate([2, 3, None] * 2000)]
    df = spark.createDataFrame(rows, "e long, us long, seq long, s string").withColumn("at", F.timestamp_micros("us"))
    cut, block = skew.history_blocks(df, ["e"], "at", "seq", rows_per_block=200)
    assert cut.groupBy("e", *block).count().agg(F.max("count")).first()[0] <= 420
    ordered = cut.orderBy("e", *block, "at", "seq").select("e", "us", "seq").collect()
    assert [tuple(r) for r in ordered] == sorted(((r[0], r[1], r[2]) for r in rows), key=lambda r: (r[0] is not None, *(v or 0 for v in r)))
    expected = {}
    for e in (1, 2, 3, None):
        own = [s for *_, s in sorted((us, i, s) for x, us, i, s in rows if x == e)]
        expected[e] = sum(a == "view" and b == "buy" for a, b in zip(own, own[1:]))
    counted = skew.transition_counts(df, ["e"], "s", "at", "seq", "view", "buy", rows_per_block=200)
    assert {r["e"]: r["n"] for r in counted.collect()} == expected


def test_paged_lists_keep_every_value(spark):
    df = spark.range(25).select(F.lit("k").alias("k"), "id", F.col("id").cast("string").alias("v"))
    pages = skew.paged_lists(df, "k", "id", "v", "vs", page_rows=10).orderBy("page").collect()
    assert [v for p in pages for v in p["vs"]] == [str(i) for i in range(25)]
    assert [len(p["vs"]) for p in pages] == [10, 10, 5]
