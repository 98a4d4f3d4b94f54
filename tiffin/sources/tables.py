"""Reading, looking up and publishing marketplace tables stored as Parquet."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.contracts import TABLES

Tables = Mapping[str, DataFrame]


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One table under its contract's schema; no inference pass over the files."""
    return spark.read.schema(TABLES[name].schema).parquet(f"{root}/{name}")


def read_tables(spark: SparkSession, root: str, names: Iterable[str] = tuple(TABLES)) -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name) for name in names}


def lookup(df: DataFrame, key: str, ids: object) -> DataFrame:
    """Rows whose ``key`` is a value, is in a short list, or is in the first column of a DataFrame.

    Values become a predicate that Parquet can skip row groups by; a DataFrame
    becomes a semi join.
    """
    if isinstance(ids, DataFrame):
        return df.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    if isinstance(ids, (list, tuple, set)):
        return df.filter(F.col(key).isin(*ids))
    return df.filter(F.col(key) == ids)


def lookup_columns(name: str) -> list[str]:
    """The columns a row of the table is looked up by: its keys and its references."""
    contract = TABLES[name]
    every = [*contract.key, *(c for u in contract.unique for c in u), *(fk.column for fk in contract.foreign)]
    return list(dict.fromkeys(every))


def publish(spark: SparkSession, tables: Tables, root: str, version: int, clustered: bool = False,
            row_group_bytes: int | None = None) -> None:
    """Write the given tables as one version; readers switch when its manifest appears.

    A repeated run of the same version overwrites its own folder only, so a job
    that died half way is simply run again.  ``clustered`` orders each table by
    its primary key, which lets look-ups and joins by order or id skip row
    groups; the range bounds use the whole key, so an order with very many lines
    is cut as well.  Columns that order does not help (other keys, references, and all
    of them where it is not ``clustered``) carry Bloom filters, of a size fitted to
    their values, so that a look-up by value still skips the row groups without it.
    """
    paths = []
    for name, df in tables.items():
        path = f"{root}/data/version={version}/{name}"
        if clustered:
            key = TABLES[name].key
            df = df.repartitionByRange(*key).sortWithinPartitions(*key)
        writer = df.write.mode("overwrite").option("parquet.bloom.filter.adaptive.enabled", "true")
        if row_group_bytes:
            writer = writer.option("parquet.block.size", row_group_bytes)
        for column in lookup_columns(name):
            if not clustered or column != TABLES[name].key[0]:
                writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
        writer.parquet(path)
        paths.append((name, path))
    (spark.createDataFrame(paths, "name string, path string").coalesce(1)
     .write.mode("overwrite").parquet(f"{root}/manifest/version={version}"))


def open_latest(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The newest published state: each table from the last version that wrote it."""
    newest = (spark.read.parquet(f"{root}/manifest")
              .groupBy("name").agg(F.max_by("path", "version").alias("path")))
    # one row per table of the contract, thirteen at most
    return {row["name"]: spark.read.schema(TABLES[row["name"]].schema).parquet(row["path"])
            for row in newest.collect()}
