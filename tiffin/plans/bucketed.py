"""Change sets written in place: tables kept in key buckets, of which only those with changes are rewritten.

A table lies in a ``BucketStore`` by the first column of its key.  A change set names the
keys that go or come, their buckets are read and written anew as one version, and all
other buckets keep their files.  Readers see a version once its list is written; a run
that died half way is run again under the same version.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.contracts import TABLES
from tiffin.plans.cascade import CascadeResult
from tiffin.streaming.state import BucketStore

Tables = Mapping[str, DataFrame]


def keep_tables(spark: SparkSession, t: Tables, root: str, names: Iterable[str], buckets: int = 64) -> dict[str, BucketStore]:
    """The named tables in buckets under ``root``; those already there stay as they are."""
    return {name: BucketStore(f"{root}/{name}", t[name].schema, TABLES[name].key[:1], buckets).open(spark, t[name])
            for name in names}


def read_tables(spark: SparkSession, stores: Mapping[str, BucketStore], version: int | None = None) -> dict[str, DataFrame]:
    """The tables as the versions up to ``version`` (default: all) left them."""
    before = None if version is None else version + 1
    return {name: store.read_all(spark, before) for name, store in stores.items()}


def delete_rows(store: BucketStore, table: str, keys: DataFrame, version: int) -> list[int]:
    """Remove the rows with the given keys; returns the buckets that were rewritten."""
    touched = store.touched(keys)
    held = store.read(keys.sparkSession, touched, version)
    store.write(version, held.join(keys.select(*TABLES[table].key).distinct(), list(TABLES[table].key), "left_anti"), touched)
    return touched


def upsert_rows(store: BucketStore, table: str, rows: DataFrame, version: int) -> list[int]:
    """Put ``rows`` in the place of those with their keys, or add them; each key comes once."""
    touched = store.touched(rows)
    held = store.read(rows.sparkSession, touched, version)
    key = list(TABLES[table].key)
    kept = held.join(rows.select(*key), key, "left_anti").select(*store.schema.names)
    store.write(version, kept.unionByName(rows.select(*store.schema.names)), touched)
    return touched


def apply_deletion(stores: Mapping[str, BucketStore], done: CascadeResult, version: int) -> dict[str, list[int]]:
    """Remove what a cascade deletes from every kept table; compute the cascade with ``stage=durable``.

    Tables are written children first, so that no version lacks a parent of rows it has."""
    order = [name for name in reversed(list(done.deleted)) if name in stores]
    return {name: delete_rows(stores[name], name, done.deleted[name], version) for name in order}


def changed_rows(before: DataFrame, after: DataFrame, table: str) -> DataFrame:
    """Rows of ``after`` that ``before`` lacks or has otherwise: what an update set changed."""
    key = list(TABLES[table].key)
    values = [c for c in after.columns if c not in key]
    old = before.select(*key, F.struct(*values).alias("_old"))
    return (after.join(old, key, "left").filter(~F.struct(*values).eqNullSafe(F.col("_old"))).select(*after.columns))
