"""Micro-batch logs: Parquet folders that a retried batch rewrites instead of doubling."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

Settle = Callable[[DataFrame, int], DataFrame]


def open_log(spark: SparkSession, path: str, schema: T.StructType, folder: str = "") -> None:
    """Make the log readable before its first batch."""
    target = f"{path}/batch_id=-1/{folder}".rstrip("/")
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(target)


def read_log(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame:
    """All rows with ``batch_id``, or those of the batches before one (a partition filter)."""
    with_batch = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    log = spark.read.schema(with_batch).parquet(path)
    return log if before is None else log.filter(F.col("batch_id") < before)


def rewrite(df: DataFrame, path: str) -> DataFrame:
    """Write a step of the current batch to a folder each batch overwrites, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def latest(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The newest row per key of an update-mode log."""
    values = [c for c in log.columns if c not in (*keys, "batch_id")]
    return (log.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
            .select(*keys, *[f"_v.{c}" for c in values]))


def log_writer(stream: DataFrame, path: str, checkpoint: str, settle: Settle | None = None,
               mode: str = "append", partition_by: Sequence[str] = (),
               trigger: Mapping[str, object] | None = None) -> DataStreamWriter:
    """Write every micro-batch, after ``settle``, to its own ``batch_id`` folder.

    ``trigger`` holds the arguments of the writer's trigger, for example
    ``{"processingTime": "1 minute"}``; by default the stream ends when it has read what is there.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = settle(batch, batch_id) if settle else batch
        writer = rows.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(f"{path}/batch_id={batch_id}")

    return (stream.writeStream.outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True}))
            .foreachBatch(write))


def drain(writer: DataStreamWriter) -> None:
    """Process what is there and stop."""
    writer.start().awaitTermination()


def compact(spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], through: int,
            target: str) -> None:
    """Write the newest row per key of all batches up to ``through`` as one batch of a new log.

    ``read_log_after`` then reads the short log and only the later batches of the
    old one, whose earlier folders are no longer needed.
    """
    newest = latest(read_log(spark, path, schema, through + 1), keys)
    newest.select(*schema.names).write.mode("overwrite").parquet(f"{target}/batch_id={through}")


def read_log_after(spark: SparkSession, target: str, path: str, schema: T.StructType, through: int) -> DataFrame:
    """The compacted log followed by the batches written since."""
    return (read_log(spark, target, schema)
            .unionByName(read_log(spark, path, schema).filter(F.col("batch_id") > through)))
