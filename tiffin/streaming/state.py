"""Keyed state of a stream in buckets, of which a micro-batch reads and rewrites only its own.

A row lies in the bucket of a hash of its keys.  A batch names the buckets of its keys
(at most ``buckets`` numbers come to the driver), reads their newest copies from before
the batch, and writes new copies under its own version.  A small list per batch says
which version of each bucket counts.  So a batch's work follows the keys it holds, not
what earlier batches left; a retried batch starts from the same lists and overwrites its
own version; and copies that no list needs any more are removed when the next batch starts.

Choose ``buckets`` so that one bucket fits a task.  Larger buckets are still written and
read by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiffin.session import remove_folder

_LIST = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])


class BucketStore:
    """Rows of ``schema`` under ``path``; the rows of one key of ``keys`` share a bucket."""

    def __init__(self, path: str, schema: T.StructType, keys: Sequence[str], buckets: int = 64):
        self.path, self.schema, self.keys, self.buckets = path, schema, list(keys), buckets

    def bucket(self, columns: Sequence[str] | None = None) -> Column:
        """The bucket of a row whose keys stand in ``columns``, of the same types as the store's."""
        typed = [F.col(c).cast(self.schema[k].dataType) for c, k in zip(columns or self.keys, self.keys, strict=True)]
        return F.pmod(F.xxhash64(*typed), F.lit(self.buckets)).cast("int")

    def open(self, spark: SparkSession, rows: DataFrame | None = None) -> BucketStore:
        """Write the first version, of ``rows`` or empty, unless there is one."""
        if not self._numbers(spark, f"{self.path}/lists", "batch_id"):
            self._put(-1, spark.createDataFrame([], self.schema) if rows is None else rows, {}, range(self.buckets))
        return self

    def touched(self, batch: DataFrame, columns: Sequence[str] | None = None) -> list[int]:
        """The buckets of the keys of ``batch``."""
        return sorted(r[0] for r in batch.select(self.bucket(columns)).distinct().collect())

    def read(self, spark: SparkSession, touched: Sequence[int], before: int | None = None) -> DataFrame:
        """The rows of some buckets as the batches before ``before`` (default: all) left them."""
        known = self._list(spark, before)
        folders = [self._folder(known[b], b) for b in touched if b in known]
        if not folders:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(*folders)

    def read_all(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        return self.read(spark, range(self.buckets), before)

    def near(self, batch: DataFrame, columns: Sequence[str] | None = None, before: int | None = None) -> DataFrame:
        """The stored rows whose keys ``batch`` names; equal nulls meet."""
        columns = list(columns or self.keys)
        named = batch.select(*[F.col(c).cast(self.schema[k].dataType).alias(f"_{k}") for c, k in zip(columns, self.keys, strict=True)]).distinct()
        held = self.read(batch.sparkSession, self.touched(batch, columns), before)
        same = F.lit(True)
        for k in self.keys:
            same = same & held[k].eqNullSafe(named[f"_{k}"])
        return held.join(named, same, "left_semi")

    def write(self, batch_id: int, rows: DataFrame, touched: Sequence[int]) -> None:
        """Replace the ``touched`` buckets by ``rows``, all of whose keys lie in them."""
        self._put(batch_id, rows, self._list(rows.sparkSession, batch_id), touched)

    def prune(self, spark: SparkSession, batch_id: int) -> None:
        """Remove copies that neither batch ``batch_id`` nor a later one reads; the one before is done."""
        past = sorted(n for n in self._numbers(spark, f"{self.path}/lists", "batch_id") if n < batch_id)
        if len(past) < 2:
            return
        needed = {(v, b) for b, v in self._list(spark, batch_id).items()}
        for version in self._numbers(spark, f"{self.path}/data", "version"):
            if version < batch_id:
                made = self._numbers(spark, f"{self.path}/data/version={version}", "_bucket")
                for bucket in made:
                    if (version, bucket) not in needed:
                        remove_folder(spark, self._folder(version, bucket))
                if not any((version, bucket) in needed for bucket in made):
                    remove_folder(spark, f"{self.path}/data/version={version}")
        for n in past[:-1]:
            remove_folder(spark, f"{self.path}/lists/batch_id={n}")

    def _folder(self, version: int, bucket: int) -> str:
        return f"{self.path}/data/version={version}/_bucket={bucket}"

    def _put(self, version: int, rows: DataFrame, known: dict[int, int], touched: Sequence[int]) -> None:
        spark, target = rows.sparkSession, f"{self.path}/data/version={version}"
        (rows.select(*self.schema.names).withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket")
         .write.mode("overwrite").partitionBy("_bucket").parquet(target))
        written = self._numbers(spark, target, "_bucket")
        now = {b: v for b, v in known.items() if b not in set(touched)} | {b: version for b in written}
        (spark.createDataFrame(sorted(now.items()), _LIST).coalesce(1)
         .write.mode("overwrite").parquet(f"{self.path}/lists/batch_id={version}"))

    def _list(self, spark: SparkSession, before: int | None) -> dict[int, int]:
        """The version of each bucket, at most ``buckets`` of them, by the newest list before a batch."""
        made = self._numbers(spark, f"{self.path}/lists", "batch_id")
        newest = max((n for n in made if before is None or n < before), default=None)
        if newest is None:
            return {}
        rows = spark.read.schema(_LIST).parquet(f"{self.path}/lists/batch_id={newest}").collect()
        return {r.bucket: r.version for r in rows}

    @staticmethod
    def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
        """The numbers of the folders ``name=number`` under ``path``."""
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in files.listStatus(place)] if files.exists(place) else []
        return [int(n.removeprefix(f"{name}=")) for n in names if n.startswith(f"{name}=")]
