"""Streams over several files, several micro-batches, give the batch results."""

import glob
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiffin.operators import cross_rules, rollups
from tiffin.operators.admission import admit_applications
from tiffin.sources import testdata
from tiffin.streaming import guards, maintenance, sinks
from tiffin.streaming.state import BucketStore

SF = "/root/testdata/sf0.001"


def stream_of(spark, df, path, files=4):
    """``df`` as a stream of one file per micro-batch."""
    df.repartition(files).write.mode("overwrite").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def bag(df):
    return sorted(tuple(r) for r in df.collect())


def run_update(spark, stream, path, key):
    sinks.open_log(spark, f"{path}/log", stream.schema)
    sinks.drain(sinks.log_writer(stream, f"{path}/log", f"{path}/checkpoint", mode="update"))
    log = sinks.read_log(spark, f"{path}/log", stream.schema)
    assert log.select("batch_id").distinct().count() > 1
    return sinks.latest(log, [key])


@pytest.fixture(scope="module")
def tables(spark):
    return testdata.load(spark, SF)


def test_points_with_repeated_changes(spark, tmp_path):
    changes = testdata.status_changes(testdata.raw(spark, SF, "events"))
    doubled = changes.unionByName(changes.filter("change_id < 50"))
    stream = maintenance.stream_points(stream_of(spark, doubled, f"{tmp_path}/in"), watermark="60 days")
    found = run_update(spark, stream, str(tmp_path), "CID")
    assert bag(found) == bag(rollups.points_from_changes(changes))


def test_points_from_snapshots(spark, tmp_path):
    snapshots = testdata.status_snapshots(testdata.raw(spark, SF, "events"))
    # four files in time order: batches arrive in order
    for part in range(4):
        (snapshots.filter((F.col("seq") >= part * 250) & (F.col("seq") < (part + 1) * 250))
         .coalesce(1).write.mode("append").parquet(f"{tmp_path}/in"))
    stream = spark.readStream.schema(snapshots.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/out"
    sinks.drain(maintenance.points_from_snapshot_stream(stream, path, f"{path}/checkpoint", buckets=8))
    assert snapshots.count() == 1000
    assert bag(maintenance.points_so_far(spark, path)) == bag(rollups.points_from_snapshots(snapshots))


def plain_points(states):
    """Points by sorting each order's states, those delivered twice once."""
    orders, points = {}, {}
    for foid, cid, status, at, seq in set(states):
        orders.setdefault((foid, cid), []).append((at, seq, status))
    for (_, cid), own in orders.items():
        steps = [s for *_, s in sorted(own)]
        n = sum(a == "confirmed" and b == "delivered" for a, b in zip(steps, steps[1:]))
        if n:
            points[cid] = points.get(cid, 0) + n * 20
    return points


def snapshot_batches(spark, path, batches):
    """A stream whose micro-batches are the given lists of states."""
    for rows in batches:
        spark.createDataFrame(rows, maintenance.STATE).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(maintenance.STATE).option("maxFilesPerTrigger", 1).parquet(path)


def made_states(n, orders, seed=1):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    return [(o, 100 + (o or 0) % 7, rng.choice(["confirmed", "delivered", "delivered", "pending"]), start + timedelta(minutes=rng.randrange(500)), i)
            for i, o in enumerate(rng.choice(orders) for _ in range(n))]


def test_late_states_correct_the_points(spark, tmp_path):
    states = made_states(240, [*range(12), None])
    states += states[:40]  # delivered twice
    random.Random(2).shuffle(states)
    stream = snapshot_batches(spark, f"{tmp_path}/in", [states[i::3] for i in range(3)])
    path = f"{tmp_path}/out"
    sinks.drain(maintenance.points_from_snapshot_stream(stream, path, f"{path}/checkpoint", buckets=4))
    assert {r.CID: r.points for r in maintenance.points_so_far(spark, path).collect()} == plain_points(states)
    assert sinks.read_log(spark, f"{path}/late", maintenance.STATE).count() == 0


def test_history_is_kept_for_the_lateness_only(spark, tmp_path):
    start = datetime(2024, 1, 1)

    def at(*rows):
        return [(1, 5, s, start + timedelta(hours=h), i) for s, h, i in rows]

    first = at(("confirmed", 0, 1), ("pending", 1, 2), ("confirmed", 50, 3), ("delivered", 60, 4))
    late = at(("confirmed", 2, 5), ("pending", 55, 6))
    stream = snapshot_batches(spark, f"{tmp_path}/in", [first, late])
    path = f"{tmp_path}/out"
    sinks.drain(maintenance.points_from_snapshot_stream(stream, path, f"{path}/checkpoint", buckets=2, lateness="INTERVAL 24 HOURS"))
    store = BucketStore(f"{path}/history", maintenance.STATE, ["FOID", "CID"], 2)
    assert sorted(r.seq for r in store.read_all(spark).collect()) == [2, 3, 4, 6]
    assert [r.seq for r in sinks.read_log(spark, f"{path}/late", maintenance.STATE).collect()] == [5]
    assert maintenance.points_so_far(spark, path).collect() == []
    log = sinks.read_log(spark, f"{path}/points", maintenance.POINTS)
    assert sorted(r.points for r in log.collect()) == [-20, 20]  # the step to delivered is taken back


def test_a_batch_reads_the_buckets_of_its_keys(spark, tmp_path):
    """The seventh batch reads no more than those before, although more is stored; old copies are gone."""
    store = BucketStore(f"{tmp_path}/store", T.StructType.fromDDL("k long, v long"), ["k"], 16).open(spark)
    sizes = []
    for batch in range(7):
        rows = spark.createDataFrame([(k, batch) for k in range(batch * 3, batch * 3 + 3)], store.schema)
        store.prune(spark, batch)
        touched = store.touched(rows)
        known = store.read(spark, touched, batch)
        sizes.append(len(known.inputFiles()))
        store.write(batch, known.unionByName(rows), touched)
        assert len(touched) <= 3
    assert store.read_all(spark).count() == 21
    assert len(store.read(spark, [0, 1, 2]).inputFiles()) < len(store.read_all(spark).inputFiles())
    assert max(sizes) <= 3
    before = {b: v for b, v in store._list(spark, None).items()}
    store.prune(spark, 7)
    folders = glob.glob(f"{tmp_path}/store/data/*/_bucket=*")
    assert len(folders) == len(before)
    # a batch that runs again starts from the same rows
    rows = spark.createDataFrame([(1, 77)], store.schema)
    for _ in range(2):
        store.write(7, store.read(spark, store.touched(rows), 7).unionByName(rows), store.touched(rows))
    assert store.read_all(spark).count() == 22
    near = store.near(spark.createDataFrame([(1,), (1,), (None,)], "key long"), ["key"])
    assert sorted(map(tuple, near.collect())) == [(1, 0), (1, 77)]


def test_point_batches_do_not_grow(spark, tmp_path, monkeypatch):
    sizes = {}
    real = BucketStore.read

    def watched(self, session, touched, before=None):
        out = real(self, session, touched, before)
        sizes[before] = max(sizes.get(before, 0), sum(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles()))
        return out

    monkeypatch.setattr(BucketStore, "read", watched)
    batches = [made_states(20, [b * 2, b * 2 + 1], seed=b) for b in range(5)]
    stream = snapshot_batches(spark, f"{tmp_path}/in", batches)
    path = f"{tmp_path}/out"
    sinks.drain(maintenance.points_from_snapshot_stream(stream, path, f"{path}/checkpoint", buckets=512))
    assert sizes[4] <= sizes[1]
    assert {r.CID: r.points for r in maintenance.points_so_far(spark, path).collect()} == plain_points([s for b in batches for s in b])


def test_order_cost(spark, tables, tmp_path):
    stream = maintenance.stream_order_cost(stream_of(spark, tables["contain"], f"{tmp_path}/in"), tables["food_item"])
    totals = run_update(spark, stream, str(tmp_path), "FOID")
    batch = rollups.order_costs(tables["food_order"], tables["contain"], tables["food_item"])
    assert bag(maintenance.order_costs_from(tables["food_order"], totals)) == bag(batch.select("ID", "orderCost"))


def test_usage(spark, tables, tmp_path):
    stream = maintenance.stream_usage(stream_of(spark, tables["apply_for"], f"{tmp_path}/in"))
    counts = run_update(spark, stream, str(tmp_path), "DFRcode")
    batch = rollups.discount_usage(tables["discount_from_restaurant"], tables["apply_for"])
    assert bag(maintenance.usage_from(tables["discount_from_restaurant"], counts)) == bag(
        batch.select("code", "used_Count"))


@pytest.mark.parametrize("bucketed", [False, True])
def test_guarded_lines(spark, tables, tmp_path, bucketed):
    stream = stream_of(spark, tables["contain"], f"{tmp_path}/in")
    kept = guards.keep_references(spark, tables, f"{tmp_path}/kept", ["food_order", "food_item"], 8) if bucketed else None
    sinks.drain(guards.guard_lines(stream, tables, f"{tmp_path}/log", f"{tmp_path}/checkpoint", kept))
    batch = cross_rules.check_line_restaurant(
        tables["contain"], tables["food_order"], tables["food_item"], tables["category"])
    judged = guards.read_judged(spark, f"{tmp_path}/log", guards.LINES)
    assert bag(judged.filter("accepted").select("FOID", "FIID")) == bag(
        batch.filter("error IS NULL").select("FOID", "FIID"))
    assert judged.filter("NOT accepted AND error IS NULL").count() == 0 and judged.count() == batch.count()


@pytest.mark.parametrize("stored, bucketed", [(False, False), (True, False), (True, True)])
def test_admission_over_batches(spark, tables, tmp_path, stored, bucketed):
    totals = rollups.order_totals(tables["contain"], tables["food_item"])
    requests = tables["apply_for"].withColumn("seq", F.col("FOID"))
    # files in seq order, the later ones repeating some earlier requests
    for part, chosen in enumerate((requests.filter("seq < 700"), requests.filter("seq >= 700"),
                                   requests.filter("seq < 100").withColumn("seq", F.col("seq") + 5000))):
        chosen.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/log"
    held = tables["apply_for"].filter("FOID < 300")
    known = dict(tables) | {"apply_for": held}
    kept = guards.keep_references(spark, known, f"{tmp_path}/kept", ["food_order", "contain", "apply_for"], 8) if bucketed else None
    sinks.drain(guards.admission(stream, known, path, f"{tmp_path}/checkpoint", stored=stored, kept=kept, buckets=8))
    judged = guards.read_judged(spark, path, guards.APPLICATIONS)
    assert judged.select("batch_id").distinct().count() == 3
    whole = spark.read.schema(requests.schema).parquet(f"{tmp_path}/in")
    batch = admit_applications(whole, tables["discount_from_restaurant"], tables["food_order"], totals,
                               held if stored else None)
    assert bag(judged.select("seq", "error")) == bag(batch.select("seq", "error"))
    limits = tables["discount_from_restaurant"].join(
        judged.filter("accepted").groupBy("DFRcode").count().withColumnRenamed("DFRcode", "code"), "code")
    assert limits.filter("count > usageLimit").count() == 0
    assert judged.filter("error LIKE 'the discount has reached%'").count() > 0


def test_a_repeated_batch_overwrites_itself(spark, tmp_path):
    schema = spark.range(0).schema
    sinks.open_log(spark, str(tmp_path), schema)
    for _ in range(2):
        spark.range(3).write.mode("overwrite").parquet(f"{tmp_path}/batch_id=0")
    assert sinks.read_log(spark, str(tmp_path), schema).count() == 3
    assert sinks.read_log(spark, str(tmp_path), schema, before=0).count() == 0


def test_compacted_log_reads_the_same(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v long").schema
    path, target = f"{tmp_path}/log", f"{tmp_path}/short"
    for batch in range(4):
        rows = [(k, batch * 10 + k) for k in range(batch, 4)]
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/batch_id={batch}")
    sinks.compact(spark, path, schema, ["k"], 2, target)
    whole = sinks.latest(sinks.read_log(spark, path, schema), ["k"])
    short = sinks.latest(sinks.read_log_after(spark, target, path, schema, 2), ["k"])
    assert bag(whole) == bag(short) == [(0, 0), (1, 11), (2, 22), (3, 33)]


def test_kept_references_hold_the_columns_a_guard_reads(spark, tables, tmp_path):
    kept = guards.keep_references(spark, tables, f"{tmp_path}/kept", ["food_order", "contain"], 8, {"food_order": ["ID"]})
    assert kept["food_order"].read_all(spark).columns == ["ID"] and kept["contain"].schema == tables["contain"].schema
    assert bag(kept["food_order"].read_all(spark)) == bag(tables["food_order"].select("ID"))
