"""Which discount applications are admitted when each discount has a usage limit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.functions import rules
from tiffin.operators.cross_rules import exceeds
from tiffin.operators.quality import narrow
from tiffin.operators.skew import distributed_rank, first_per_key, spread_join


def admit_applications(applications: DataFrame, discounts: DataFrame, orders: DataFrame,
                       totals: DataFrame, existing: DataFrame | None = None, seq: str = "seq",
                       stage: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Applications ``(DFRcode, FOID, seq)`` with ``error``, NULL where admitted.

    Rows are taken in ``seq`` order, one after another: first the discount cap,
    then the key, then the references, then the limit.  A refused row is not
    stored and uses no quota, so a later row for its pair gets the same message,
    and only a row after an admitted one breaks the key.

    Cap, stored key and references depend on the pair alone, so pairs are judged
    once each, with one row per pair: the pairs that pass are ranked within their
    code by their first row, and the limit decides on that rank.  The outcome is
    joined back to the rows.  ``stage=durable`` writes the judged pairs, which
    ranking reads twice.
    """
    pair = ["DFRcode", "FOID"]
    first = first_per_key(applications, pair, seq, "_first")
    stored = first.select(*pair).limit(0) if existing is None else existing.select(*pair)
    known = narrow(stored, first, pair).distinct().withColumn("_stored", F.lit(True))
    limits = discounts.select(F.col("code").alias("DFRcode"), "usageLimit", "used_Count", "value",
                              F.lit(True).alias("_code"))
    per_code = first.groupBy("DFRcode").agg(F.count(F.lit(1)).alias("n"))
    order_facts = (orders.select(F.col("ID").alias("FOID"), F.lit(True).alias("_order"))
                   .join(totals.select("FOID", F.col("total").alias("_total")), "FOID", "left"))
    early = rules.first_error(
        (exceeds(F.col("value"), F.col("_total")), rules.MSG_DISCOUNT_CAP),
        (F.col("_stored"), rules.MSG_KEY),
        (F.col("_code").isNull() | F.col("_order").isNull(), rules.MSG_REFERENCE))
    at_order = spread_join(first.join(known, pair, "left"), order_facts, ["FOID"], "left", ["DFRcode"],
                           counts=first.groupBy("FOID").agg(F.count(F.lit(1)).alias("n")))
    judged = stage(spread_join(at_order, limits, ["DFRcode"], "left", ["FOID"], counts=per_code)
                   .select(*pair, "_first", "n", "usageLimit", "used_Count", early.alias("_early")))
    over = F.col("used_Count") + F.col("rank") > F.col("usageLimit")
    outcome = (distributed_rank(judged, "_first", ["DFRcode"], counting=F.col("_early").isNull())
               .withColumn("_error", F.coalesce(F.col("_early"), F.when(over, F.lit(rules.MSG_QUOTA))))
               .select(*pair, "_first", "n", "_error"))
    error = (F.when(F.col("_first").isNull(), F.lit(rules.MSG_REFERENCE))  # no code or no order
             .otherwise(F.coalesce(F.col("_error"), F.when(F.col(seq) > F.col("_first"), F.lit(rules.MSG_KEY)))))
    return (spread_join(applications, outcome, pair, "left", [seq], counted="n")
            .withColumn("error", error).select(*applications.columns, "error"))
