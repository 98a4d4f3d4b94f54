"""Compare a query with its SQL: same columns, same rows, any order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLE_NAMES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


def sql_rows(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLE_NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def _bag(columns: list[str], rows: list[tuple]) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return ([columns[i] for i in order],
            Counter(tuple(_plain(row[i]) for i in order) for row in rows))


def differences(df, sf_dir: str, sql: str) -> str | None:
    """None when equal, else a short account of the difference."""
    spark_columns, spark_bag = _bag(df.columns, [tuple(r) for r in df.collect()])
    sql_columns, sql_bag = _bag(*sql_rows(sf_dir, sql))
    if spark_columns != sql_columns:
        return f"columns {spark_columns} != {sql_columns}"
    if spark_bag != sql_bag:
        only_spark = list((spark_bag - sql_bag).items())[:3]
        only_sql = list((sql_bag - spark_bag).items())[:3]
        return (f"{sum(spark_bag.values())} vs {sum(sql_bag.values())} rows; "
                f"only here {only_spark}; only SQL {only_sql}")
    return None
