"""Running roll-ups over append-only change streams.

Aggregates combine on the map side of every micro-batch, so a hot customer,
order or code reaches its state as one row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tiffin.operators.rollups import (
    POINTS_PER_DELIVERY,
    order_totals,
    points_from_changes,
)
from tiffin.operators.skew import transition_counts
from tiffin.streaming.sinks import log_writer, open_log, read_log, rewrite
from tiffin.streaming.state import BucketStore


def stream_points(changes: DataFrame, watermark: str = "1 hour",
                  points: int = POINTS_PER_DELIVERY) -> DataFrame:
    """Running ``(CID, points)`` from changes ``(change_id, at, CID, old_status, new_status)``.

    A change delivered twice within the watermark counts once.  Update mode.
    """
    once = changes.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["change_id"])
    return points_from_changes(once, points)


def stream_order_cost(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Running ``(FOID, total)`` over streamed lines and the stored items.  Update mode.

    The fee is a column of the stored orders and is added when the log is read
    (``order_costs_from``).
    """
    return order_totals(lines, items)


def order_costs_from(orders: DataFrame, totals: DataFrame) -> DataFrame:
    """``(ID, orderCost)`` from the newest totals."""
    cost = F.coalesce(F.col("total") + F.col("delivery_fee"), F.lit(0).cast("long"))
    return (orders.select("ID", "delivery_fee")
            .join(totals.withColumnRenamed("FOID", "ID"), "ID", "left")
            .select("ID", cost.alias("orderCost")))


def stream_usage(applications: DataFrame) -> DataFrame:
    """Running ``(DFRcode, n)``.  Update mode."""
    return applications.groupBy("DFRcode").agg(F.count(F.lit(1)).alias("n"))


def usage_from(discounts: DataFrame, counts: DataFrame) -> DataFrame:
    """``(code, used_Count)`` from the newest counts."""
    return (discounts.select("code", "used_Count")
            .join(counts.withColumnRenamed("DFRcode", "code"), "code", "left")
            .select("code", (F.col("used_Count") + F.coalesce(F.col("n"), F.lit(0))).alias("used_Count")))


STATE = T.StructType([
    T.StructField("FOID", T.LongType()), T.StructField("CID", T.LongType()),
    T.StructField("order_status", T.StringType()), T.StructField("at", T.TimestampType()),
    T.StructField("seq", T.LongType())])
POINTS = T.StructType([T.StructField("CID", T.LongType()), T.StructField("points", T.LongType())])
ORDER, MOMENT = ["FOID", "CID"], ["at", "seq"]


def points_from_snapshot_stream(snapshots: DataFrame, path: str, checkpoint: str,
                                before: str = "confirmed", after: str = "delivered",
                                points: int = POINTS_PER_DELIVERY, buckets: int = 64,
                                lateness: str | None = None) -> DataStreamWriter:
    """Points earned per batch, from streamed order states without the old status, in any order of arrival.

    A state that arrives between two known ones takes back their step and adds two, so
    ``{path}/points`` holds signed corrections per customer: what the touched orders are
    worth with the new states, less what they were worth without.  A state delivered
    twice (same order, ``at`` and ``seq``) counts once.

    ``{path}/history`` keeps the states of every order in buckets of which a batch reads
    and rewrites its own.  With ``lateness`` (an interval such as ``INTERVAL 7 DAYS``) an
    order keeps its states of that time before its newest one, and the last one before
    them; older arrivals are not counted but listed under ``{path}/late``.
    """
    spark = snapshots.sparkSession
    store = BucketStore(f"{path}/history", STATE, ORDER, buckets).open(spark)
    open_log(spark, f"{path}/points", POINTS)
    open_log(spark, f"{path}/late", STATE)

    def settle(batch: DataFrame, batch_id: int) -> DataFrame:
        own = batch.sparkSession
        store.prune(own, batch_id)
        arrived = rewrite(batch.select(*STATE.names).dropDuplicates([*ORDER, *MOMENT]), f"{path}/arrived")
        touched = store.touched(arrived)
        known = store.read(own, touched, batch_id)
        mine = rewrite(store.near(arrived, before=batch_id), f"{path}/mine")
        fresh = rewrite(_without(arrived, mine, [*ORDER, *MOMENT]), f"{path}/fresh")
        if lateness is not None:
            fresh = _beside(fresh, _newest(mine)).select(
                *STATE.names, F.coalesce(F.col("at") < F.col("_newest") - F.expr(lateness), F.lit(False)).alias("late"))
            fresh.filter("late").select(*STATE.names).write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
            fresh = fresh.filter("NOT late").drop("late")
        now = known.unionByName(fresh)
        store.write(batch_id, now if lateness is None else recent_states(now, lateness), touched)
        with_and_without = (mine.withColumn("_sign", F.lit(-1)).unionByName(mine.withColumn("_sign", F.lit(1)))
                            .unionByName(fresh.withColumn("_sign", F.lit(1))))
        steps = transition_counts(with_and_without, [*ORDER, "_sign"], "order_status", *MOMENT, before, after)
        return steps.groupBy("CID").agg((F.sum(F.col("_sign") * F.col("n")) * points).alias("points")).filter("points <> 0")

    return log_writer(snapshots, f"{path}/points", checkpoint, settle)


def _beside(left: DataFrame, right: DataFrame, keys: Sequence[str] = ORDER, how: str = "left") -> DataFrame:
    """A join where equal nulls meet."""
    named = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(named[f"_{k}"])
    return left.join(named, same, how)


def _without(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    return _beside(left, right.select(*keys), keys, "left_anti")


def _newest(history: DataFrame) -> DataFrame:
    return history.groupBy(*ORDER).agg(F.max("at").alias("_newest"))


def recent_states(history: DataFrame, lateness: str) -> DataFrame:
    """Per order the states of the last ``lateness`` before its newest one, and the last one before them."""
    near = F.coalesce(F.col("at") >= F.col("_newest") - F.expr(lateness), F.lit(False))
    told = _beside(history, _newest(history)).select(*STATE.names, near.alias("_near"))
    before = told.filter("NOT _near").groupBy(*ORDER).agg(
        F.max_by(F.struct("order_status", *MOMENT), F.struct(*MOMENT)).alias("_s"))
    return told.filter("_near").select(*STATE.names).unionByName(
        before.select(*ORDER, "_s.order_status", "_s.at", "_s.seq"))


def points_so_far(spark: SparkSession, path: str) -> DataFrame:
    """``(CID, points)`` over all batches; corrections may leave a customer without any."""
    log = read_log(spark, f"{path}/points", POINTS)
    return log.groupBy("CID").agg(F.sum("points").alias("points")).filter("points <> 0")
