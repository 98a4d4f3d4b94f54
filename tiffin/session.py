"""Session settings and durable intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tiffin", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on.

    On a cluster shuffles start with many partitions and AQE merges the small
    ones to about 128 MB.  Streaming state goes to RocksDB because the per-order
    state does not fit on the heap at scale.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass":
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.ui.enabled": "false",
    }
    if not (master or "").startswith("local"):
        settings["spark.sql.adaptive.coalescePartitions.initialPartitionNum"] = "8000"
    settings |= conf
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return named


def name_local_dir(spark: SparkSession) -> None:
    """Name a temporary folder for a local session that has none; callers that own
    the session (catalog, bench) use it, the operators never do.  It goes with the process."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="tiffin-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", made)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    The copy outlives the executors that made it, every later reader sees the
    same rows and reads only the columns it needs, and its size is known, so
    joins against it are planned by size.  Use a ``Stage`` where the copies can
    be removed when the job is over.
    """
    return Stage(df.sparkSession)(df)


class Stage:
    """Makes durable copies, as ``durable`` does, and removes them on ``close``.

    >>> with Stage(spark) as stage:
    ...     changes.delete_orders(tables, requests, stage=stage).rejects.write.parquet(out)
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._root = f"{shared_dir(spark)}/tiffin-stage/{uuid.uuid4().hex}"
        self._made: list[str] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self._root}/{len(self._made)}"
        self._made.append(path)
        df.write.parquet(path)
        return self._spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Stage:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        """Remove every copy made so far; frames that read them end here."""
        if self._made:
            remove_folder(self._spark, self._root)
            self._made.clear()
