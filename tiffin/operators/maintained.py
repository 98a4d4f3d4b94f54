"""Stored roll-ups kept right by the changes alone.

A change set says which rows went, came or moved.  ``total_changes`` and ``usage_changes``
turn that into signed amounts per key, and ``merged`` adds them to the stored roll-up.
Only the changed rows are joined and summed; the stored roll-up is read once and, as the
changes of a batch are few, neither shuffled nor recomputed.  The result equals the
roll-up of the changed tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.operators.quality import narrow

Tables = Mapping[str, DataFrame]
Stage = Callable[[DataFrame], DataFrame]


def stored_totals(lines: DataFrame, items: DataFrame) -> DataFrame:
    """``(FOID, total, lines)`` per order with lines: the number of lines tells when an order has none left."""
    return _summed(lines, items.select(F.col("ID").alias("FIID"), F.col("price").cast("long").alias("_price")))


def _summed(lines: DataFrame, prices: DataFrame, sign: int = 1, counted: int = 1) -> DataFrame:
    return lines.join(prices, "FIID").groupBy("FOID").agg(
        F.sum(sign * F.col("_price") * F.col("quantity")).alias("total"),
        (counted * F.count(F.lit(1))).cast("long").alias("lines"))


def total_changes(before: Tables, removed: DataFrame | None = None, added: DataFrame | None = None,
                  items: DataFrame | None = None, stage: Stage = lambda df: df) -> DataFrame:
    """``(FOID, total, lines)`` to add to the stored totals, several rows an order.

    ``before`` are the tables as they were.  ``removed`` (FOID, FIID) are keys of lines that went, at the old price;
    ``added`` lines (FOID, FIID, quantity) that came, at the new one.  ``items`` (ID, price) are the changed items with
    their new price: the lines that stay with them move by the difference.  An item that went with its lines need not
    be among ``items``.  Removed keys and their lines are read more than once; ``stage=durable`` writes them once.
    """
    lines, old = before["contain"], before["food_item"].select("ID", "price")
    price = lambda df: df.select(F.col("ID").alias("FIID"), F.col("price").cast("long").alias("_price"))
    parts = []
    if removed is not None:
        removed = stage(removed.select("FOID", "FIID").distinct())
        gone = stage(lines.join(removed, ["FOID", "FIID"], "left_semi"))
        parts.append(_summed(gone, price(narrow(old.withColumnRenamed("ID", "FIID"), gone, ["FIID"]).withColumnRenamed("FIID", "ID")), -1, -1))
    if items is not None:
        moved = stage(old.withColumnRenamed("price", "_old").join(
            items.select("ID", F.col("price").alias("_new")), "ID").filter("_old <> _new"))
        stay = narrow(lines, moved.select(F.col("ID").alias("FIID")), ["FIID"])
        if removed is not None:
            stay = stay.join(removed, ["FOID", "FIID"], "left_anti")
        difference = moved.select(F.col("ID").alias("FIID"), (F.col("_new").cast("long") - F.col("_old")).alias("_price"))
        parts.append(_summed(stay, difference, 1, 0))
    if added is not None:
        now = old if items is None else old.join(items.select("ID"), "ID", "left_anti").unionByName(items.select("ID", "price"))
        named = now.join(added.select(F.col("FIID").alias("ID")).distinct(), "ID", "left_semi")
        parts.append(_summed(added, price(named)))
    if not parts:
        return stored_totals(lines.limit(0), before["food_item"])
    return reduce(DataFrame.unionByName, parts)


def usage_changes(removed: DataFrame | None = None, added: DataFrame | None = None) -> DataFrame:
    """``(DFRcode, n)`` to add to stored counts of applications, from rows that went and came."""
    parts = [rows.groupBy("DFRcode").agg((sign * F.count(F.lit(1))).cast("long").alias("n"))
             for rows, sign in ((removed, -1), (added, 1)) if rows is not None]
    return reduce(DataFrame.unionByName, parts)


def merged(stored: DataFrame, changes: DataFrame, key: str, measures: Sequence[str], counter: str | None = None,
           stage: Stage = lambda df: df) -> DataFrame:
    """``stored`` (key, measures) with ``changes`` added; a key whose ``counter`` falls to 0 goes, a new one comes.

    The summed changes are read twice; ``stage=durable`` writes them once, so that their size decides the join."""
    summed = stage(changes.groupBy(key).agg(*[F.sum(m).alias(f"_{m}") for m in measures]))
    met = stored.join(summed, key, "left").select(
        key, *[(F.col(m) + F.coalesce(F.col(f"_{m}"), F.lit(0))).alias(m) for m in measures])
    new = summed.join(narrow(stored.select(key), summed, [key]), key, "left_anti").select(
        key, *[F.col(f"_{m}").alias(m) for m in measures])
    both = met.unionByName(new)
    return both if counter is None else both.filter(F.col(counter) > 0)
