"""Bulk load: defaults, generated keys, validation, append."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tiffin.contracts import TABLES
from tiffin.functions.rules import first_error
from tiffin.operators.quality import exists_in, row_rules
from tiffin.operators.sequential import first_come
from tiffin.operators.skew import distributed_rank
from tiffin.sources.tables import Tables

Stage = Callable[[DataFrame], DataFrame]


def read_csv_rows(spark: SparkSession, path: str, table: str, columns: list[str] | None = None,
                  null_value: str = "") -> DataFrame:
    """Rows of ``table`` from headed CSV files; ``columns`` lists the file's columns when some are left out.

    ``null_value`` is what stands for NULL; with another mark than the empty text, empty fields are empty texts.
    """
    schema = TABLES[table].schema
    names = columns or schema.names
    picked = type(schema)([schema[n] for n in names])
    return spark.read.schema(picked).option("header", True).option("enforceSchema", False).option(
        "nullValue", null_value).csv(path)


def apply_defaults(df: DataFrame, table: str) -> DataFrame:
    """Add the columns that were left out: their default, else NULL.  A given NULL stays NULL."""
    out = df
    for column in TABLES[table].columns:
        if column.name not in df.columns:
            out = out.withColumn(column.name, F.lit(column.default).cast(column.type))
    return out


def next_id(existing: DataFrame, key: str = "ID") -> Column:
    """The largest id in use (0 for an empty table), as a scalar subquery."""
    return existing.select(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("_base")).scalar()


def assign_ids(df: DataFrame, base: Column | int, order_by: str, key: str = "ID") -> DataFrame:
    """``key = base + 1, base + 2, ...`` in ``order_by`` order, without gathering the rows."""
    base = F.lit(base) if isinstance(base, int) else base
    return (distributed_rank(df, order_by, rank="_rank")
            .withColumn(key, (base + F.col("_rank")).cast("long"))
            .drop("_rank"))


class LoadRefused(ValueError):
    """A strict load that was refused; ``refused`` counts its rows per rule, each under the first rule it breaks."""

    def __init__(self, table: str, refused: dict[str, int]):
        super().__init__(f"{table}: " + ", ".join(f"{name} ({n})" for name, n in refused.items()))
        self.refused = refused


def _settled_or_refused(table: str, rows: DataFrame, error: str, names: list[str], stage: Stage) -> DataFrame:
    """``rows`` staged if none has an ``error``; else ``LoadRefused`` with what was counted while they were written."""
    counts = [F.count_if(F.col(error) == name).alias(f"n{i}") for i, name in enumerate(names)]
    seen = Observation()
    watched = rows.observe(seen, *counts)
    written = stage(watched)
    found = rows.agg(*counts).first().asDict() if written is watched else seen.get
    refused = {name: found[f"n{i}"] for i, name in enumerate(names) if found[f"n{i}"]}
    if refused:
        raise LoadRefused(table, refused)
    return rows if written is watched else written


def load_rows(tables: Tables, table: str, rows: DataFrame, order_by: str = "seq",
              strict: bool = False, stage: Stage = lambda df: df) -> tuple[DataFrame, DataFrame]:
    """``(table with the accepted rows, rejects)`` for a bulk insert into one table.

    ``rows`` carry ``order_by``, a unique integer.  Row rules, key, unique columns
    and foreign keys decide row by row; the source system would undo a whole
    multi-row statement, so ``strict`` raises ``LoadRefused`` before it returns if any row is refused.
    ``stage=durable`` judges the rows once where both results are written; the refused rows of each
    rule are then counted while the rows are written, so ``strict`` needs no further job to decide.
    Keys are settled among rows that pass all other rules.
    """
    contract = TABLES[table]
    stored = tables[table]
    filled = apply_defaults(rows, table)
    keysets = [contract.key, *contract.unique]
    if contract.generated_key and contract.key[0] not in rows.columns:
        # numbered before validation: a refused row leaves a gap, as auto-increment does
        filled = assign_ids(filled, next_id(stored, contract.key[0]), order_by, contract.key[0])
        keysets = keysets[1:]
    judged = filled
    ladder = [(violated, name) for name, violated, _ in row_rules(contract)]
    for i, fk in enumerate(contract.foreign):
        judged = exists_in(judged, tables[fk.parent], {fk.column: fk.parent_column}, f"_fk{i}", unique=True)
        ladder.append((F.col(fk.column).isNotNull() & ~F.col(f"_fk{i}"), f"foreign_key_{fk.column}"))
    judged = judged.withColumn("error", first_error(*ladder)).drop(*[f"_fk{i}" for i in range(len(contract.foreign))])
    judged = _settled_or_refused(table, judged, "error", [name for _, name in ladder], stage) if strict else stage(judged)
    valid = judged.filter(F.col("error").isNull()).drop("error")
    invalid = judged.filter(F.col("error").isNotNull())
    if keysets:
        kinds = ["key" if list(k) == list(contract.key) else "unique" for k in keysets]
        names = [f"{kind}_{'_'.join(k)}" for kind, k in zip(kinds, keysets)]
        settled = first_come(valid, stored, keysets, order_by, names)
        if strict:
            settled = _settled_or_refused(table, settled, "conflict", names, stage)
        valid = settled.filter(F.col("conflict").isNull()).drop("conflict")
        invalid = invalid.unionByName(
            settled.filter(F.col("conflict").isNotNull()).withColumnRenamed("conflict", "error"))
    names = contract.schema.names
    return stored.select(*names).unionByName(valid.select(*names)), invalid
