"""Refusing streamed rows: order lines, discount applications, and applications over their limit.

Each judged micro-batch is written once, split into the folders
``accepted=true`` and ``accepted=false``; refused rows carry ``error``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tiffin.operators.admission import admit_applications
from tiffin.operators.cross_rules import check_discount_cap, check_line_restaurant
from tiffin.operators.quality import narrow
from tiffin.operators.rollups import order_totals
from tiffin.streaming.sinks import log_writer, open_log, rewrite
from tiffin.streaming.state import BucketStore

Tables = Mapping[str, DataFrame]

LINES = T.StructType([
    T.StructField("FOID", T.LongType()), T.StructField("FIID", T.LongType()),
    T.StructField("quantity", T.IntegerType()), T.StructField("error", T.StringType())])
APPLICATIONS = T.StructType([
    T.StructField("DFRcode", T.StringType()), T.StructField("FOID", T.LongType()),
    T.StructField("seq", T.LongType()), T.StructField("error", T.StringType())])


def read_judged(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The judged rows of all batches, with ``accepted`` and ``batch_id``."""
    full = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType()),
                         T.StructField("accepted", T.BooleanType())])
    return spark.read.schema(full).parquet(path)


def _flag(judged: DataFrame, schema: T.StructType) -> DataFrame:
    return judged.select(*schema.names, F.col("error").isNull().alias("accepted"))


#: The key by which a batch looks up each stored table.
REFERENCES = {"food_order": "ID", "food_item": "ID", "contain": "FOID", "apply_for": "FOID"}


def keep_references(spark: SparkSession, t: Tables, path: str, names: Sequence[str],
                    buckets: int = 64, columns: Mapping[str, Sequence[str]] | None = None) -> dict[str, BucketStore]:
    """Stored tables laid out by key under ``path``, once: from then on a batch reads the buckets of its own keys.

    ``columns`` names those a guard reads of a wide table, its key among them; the others are neither shuffled nor written."""
    kept = {name: t[name].select(*columns[name]) if name in (columns or {}) else t[name] for name in names}
    return {name: BucketStore(f"{path}/{name}", rows.schema, [REFERENCES[name]], buckets).open(spark, rows)
            for name, rows in kept.items()}


def _named(t: Tables, name: str, batch: DataFrame, batch_key: str, kept: Mapping[str, BucketStore]) -> DataFrame:
    """The rows of a stored table that the batch names: from its buckets, or by a scan where it is not kept in such."""
    key = REFERENCES[name]
    if name in kept:
        return kept[name].near(batch, [batch_key])
    return narrow(t[name], batch.select(F.col(batch_key).alias(key)), [key])


def guard_lines(lines: DataFrame, t: Tables, path: str, checkpoint: str,
                kept: Mapping[str, BucketStore] | None = None) -> DataStreamWriter:
    """Lines whose item is of another restaurant than their order are refused.

    ``kept`` (``keep_references``) holds tables that need not be scanned for every batch."""

    def settle(batch: DataFrame, _: int) -> DataFrame:
        # written out, so that the joins with them are plain ones that AQE can split by a hot key
        orders = rewrite(_named(t, "food_order", batch, "FOID", kept or {}), f"{path}-orders")
        items = rewrite(_named(t, "food_item", batch, "FIID", kept or {}), f"{path}-items")
        return _flag(check_line_restaurant(batch, orders, items, t["category"]), LINES)

    return log_writer(lines, path, checkpoint, settle, partition_by=["accepted"])


def _totals(t: Tables, batch: DataFrame, kept: Mapping[str, BucketStore]) -> DataFrame:
    return order_totals(_named(t, "contain", batch, "FOID", kept), t["food_item"])


def guard_applications(applications: DataFrame, t: Tables, path: str, checkpoint: str,
                       kept: Mapping[str, BucketStore] | None = None) -> DataStreamWriter:
    """Applications over the discount cap are refused."""

    def settle(batch: DataFrame, _: int) -> DataFrame:
        return _flag(check_discount_cap(batch, t["discount_from_restaurant"], _totals(t, batch, kept or {})), APPLICATIONS)

    return log_writer(applications, path, checkpoint, settle, partition_by=["accepted"])


USED = T.StructType([T.StructField("DFRcode", T.StringType()), T.StructField("n", T.LongType())])
TAKEN = T.StructType([T.StructField("DFRcode", T.StringType()), T.StructField("FOID", T.LongType())])


def admission(applications: DataFrame, t: Tables, path: str, checkpoint: str, stored: bool = True,
              kept: Mapping[str, BucketStore] | None = None, buckets: int = 64) -> DataStreamWriter:
    """Applications are admitted while their discount has uses left, batch after batch.

    What earlier batches admitted raises the used counts and holds the keys, as do
    the applications in ``t`` unless ``stored`` is false (then ``t`` need not hold
    any); the batch itself is ordered by ``seq``.  Counts lie by code in
    ``{path}-used``, pairs by order in ``{path}-taken``: a batch reads and rewrites
    the buckets of its own codes and orders.
    """
    spark = applications.sparkSession
    open_log(spark, path, APPLICATIONS, "accepted=true")
    counts = BucketStore(f"{path}-used", USED, ["DFRcode"], buckets).open(spark)
    pairs = BucketStore(f"{path}-taken", TAKEN, ["FOID"], buckets).open(spark)

    def settle(batch: DataFrame, batch_id: int) -> DataFrame:
        own = batch.sparkSession
        for store in (counts, pairs):
            store.prune(own, batch_id)
        asked = rewrite(batch, f"{path}-asked")
        codes, orders = counts.touched(asked), pairs.touched(asked)
        used, taken = counts.read(own, codes, batch_id), pairs.read(own, orders, batch_id)
        discounts = t["discount_from_restaurant"].join(used.select(F.col("DFRcode").alias("code"), "n"), "code", "left").withColumn(
            "used_Count", F.col("used_Count") + F.coalesce("n", F.lit(0))).drop("n")
        existing = narrow(taken, asked, ["FOID"])
        if stored:
            existing = existing.unionByName(_named(t, "apply_for", asked, "FOID", kept or {}).select("DFRcode", "FOID"))
        judged = rewrite(admit_applications(
            asked, discounts, _named(t, "food_order", asked, "FOID", kept or {}), _totals(t, asked, kept or {}),
            existing=existing, stage=lambda df: rewrite(df, f"{path}-stage")), f"{path}-judged")
        new = judged.filter(F.col("error").isNull()).select("DFRcode", "FOID")
        more = new.groupBy("DFRcode").agg(F.count(F.lit(1)).alias("n"))
        counts.write(batch_id, used.unionByName(more).groupBy("DFRcode").agg(F.sum("n").alias("n")), codes)
        pairs.write(batch_id, taken.unionByName(new), orders)
        return _flag(judged, APPLICATIONS)

    return log_writer(applications, path, checkpoint, settle, partition_by=["accepted"])
