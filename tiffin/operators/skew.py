"""Joins, ranks and lists that stay balanced when one key holds much of the data.

AQE already splits a skewed sort-merge join when both sides arrive straight from
their own shuffle, so a plain ``join`` against a stored table needs nothing from
here.  It cannot split two other shapes, which is what this module is for:

* a join whose other side was just aggregated on the join key (the aggregate
  sits between the shuffle and the join) -> ``spread_join``;
* a window, which always gathers a whole key in one task -> ``distributed_rank``
  and ``transition_counts``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# rows of one key a task may get
ROWS_PER_SLICE = 1_000_000
# entries of the broadcast list of hot keys; with more rows than this many slices, slices grow instead
HOT_KEYS = 100_000
_NULL_SLICES = 4096


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left",
                spread_by: Sequence[str] = (), counts: DataFrame | None = None,
                counted: str | None = None, rows_per_slice: int | None = None) -> DataFrame:
    """``left.join(right, on, how)`` with every hot key of ``left`` cut into slices.

    A key with more than ``rows_per_slice`` rows (``ROWS_PER_SLICE``) gets one
    slice per so many rows; its rows go to a slice by a hash of ``spread_by``
    (stable under task retry) and its ``right`` rows are copied to each slice.
    Other keys are untouched.

    The hot keys are broadcast.  Slices hold at least ``rows(left) / HOT_KEYS``
    rows, so there are never more than ``HOT_KEYS`` of them.  They are counted in ``left`` unless the
    counts are at hand: ``counts`` (columns ``on`` plus ``n``) is an aggregate of
    the stored rows behind ``left``, whose own joins would otherwise run twice;
    ``counted`` names the column of ``right`` that holds them, and is dropped.
    ``left`` rows with a NULL key match nothing and are dealt out evenly.
    """
    on = list(on)
    rows_per_slice = rows_per_slice or ROWS_PER_SLICE
    spread_by = list(spread_by) or [c for c in left.columns if c not in on] or on
    if counts is None and counted:
        counts = right.select(*on, F.col(counted).alias("n"))
    elif counts is None:
        counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("n"))
    least = counts.agg(F.greatest(F.lit(rows_per_slice).cast("double"), F.coalesce(
        F.sum("n"), F.lit(0)) / HOT_KEYS).alias("least")).scalar()
    slices = F.ceil(F.col("n") / least).cast("int")
    hot = counts.filter(F.col("n") > least).select(*on, slices.alias("_slices"))

    has_null = F.lit(False)
    for name in on:
        has_null = has_null | F.col(name).isNull()
    dealt = F.xxhash64(*spread_by)
    slice_ = (F.when(has_null, F.pmod(dealt, F.lit(_NULL_SLICES)))
              .when(F.col("_slices").isNotNull(), F.pmod(dealt, F.col("_slices")))
              .otherwise(F.lit(0)).cast("int"))
    cut = left.join(F.broadcast(hot), on, "left").select(*left.columns, slice_.alias("_slice"))
    if counted:
        own = F.greatest(F.ceil(F.col(counted) / least).cast("int"), F.lit(1))
        numbered = right.withColumn("_slices", own).drop(counted)
    else:
        numbered = right.join(F.broadcast(hot), on, "left")
    copies = numbered.withColumn("_slice", F.explode(F.sequence(
        F.lit(0), F.coalesce(F.col("_slices"), F.lit(1)) - 1))).drop("_slices")
    return cut.join(copies, [*on, "_slice"], how).drop("_slice")


def distributed_rank(df: DataFrame, order_by: str, keys: Sequence[str] = (),
                     rank: str = "rank", counting: Column | None = None) -> DataFrame:
    """1-based rank by the integer column ``order_by``, per ``keys`` or over all rows.

    The value range is cut into blocks of 2^21.  Blocks are counted (with map-side
    combine), the counts are summed up in order, and only rows of one block are
    sorted together, so no task holds more than about two million distinct
    values however large a key is.  No sampling is involved: a retried task
    computes the same rank.

    With ``counting`` the rank is the number of rows up to and including this
    one for which the condition holds.  All rows are kept: a NULL in ``order_by``
    comes first, a NULL key has a NULL rank.  ``order_by`` should be unique
    within a key (equal values are ranked in an arbitrary order).
    """
    keys = list(keys)
    counting = F.lit(True) if counting is None else F.coalesce(counting, F.lit(False))
    position = F.coalesce(F.col(order_by).cast("long"), F.lit(-2**63))
    blocked = df.withColumns({
        "_far": F.shiftright(position, 42),
        "_near": F.shiftright(position, 21),
        "_counts": counting.cast("long"),
    })
    before = (Window.unboundedPreceding, -1)
    near = blocked.groupBy(*keys, "_far", "_near").agg(F.sum("_counts").alias("_n"))
    far = (near.groupBy(*keys, "_far").agg(F.sum("_n").alias("_m"))
           .withColumn("_far_off", F.coalesce(F.sum("_m").over(
               Window.partitionBy(*keys).orderBy("_far").rowsBetween(*before)), F.lit(0)))
           .drop("_m"))
    offsets = (near
               .withColumn("_near_off", F.coalesce(F.sum("_n").over(
                   Window.partitionBy(*keys, "_far").orderBy("_near").rowsBetween(*before)),
                   F.lit(0)))
               .join(far, [*keys, "_far"])
               .select(*keys, "_far", "_near", (F.col("_far_off") + F.col("_near_off")).alias("_off")))
    within = F.sum("_counts").over(
        Window.partitionBy(*keys, "_far", "_near").orderBy(F.col(order_by))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (blocked.join(offsets, [*keys, "_far", "_near"], "left")
            .withColumn(rank, F.col("_off") + within)
            .drop("_far", "_near", "_off", "_counts"))


def paged_lists(df: DataFrame, key: str, order_by: str, value: str, listed: str,
                page_rows: int = 10_000) -> DataFrame:
    """``value`` collected per ``key`` in ``order_by`` order, at most ``page_rows`` a row.

    A key with up to ``page_rows`` values is one row with ``page`` 0; a larger one
    continues on pages 1, 2, ... so nothing is dropped and no row grows without
    bound.
    """
    ranked = distributed_rank(df, order_by, [key], "_rank")
    page = F.floor((F.col("_rank") - 1) / page_rows).cast("long")
    items = F.sort_array(F.collect_list(F.struct("_rank", value)))
    return (ranked.groupBy(key, page.alias("page")).agg(items.alias("_items"))
            .select(key, "page", F.transform("_items", lambda i: i[value]).alias(listed)))


def transition_counts(history: DataFrame, entity: Sequence[str], status: str, at: str, tie: str,
                      before: str, after: str, bucket: str = "hour", rows_per_block: int | None = None) -> DataFrame:
    """How often ``status`` went from ``before`` straight to ``after``, per entity.

    Rows are ordered by ``(at, tie)``.  An entity's history is cut into blocks
    (``history_blocks``); each block counts its own transitions and keeps its first and
    last status, and the steps from one block to the next are counted on these
    summaries.  So no task sorts more than a block, however many rows an entity
    has in one bucket or at one moment.
    """
    entity = list(entity)
    order = F.struct(at, tie)
    cut, block = history_blocks(history, entity, at, tie, bucket, rows_per_block)
    previous = F.lag(status).over(Window.partitionBy(*entity, *block).orderBy(at, tie))
    summary = (cut.withColumn("_previous", previous)
               .groupBy(*entity, *block)
               .agg(F.count_if(_step(F.col("_previous"), F.col(status), before, after)).alias("_inner"),
                    F.min_by(status, order).alias("_first"),
                    F.max_by(status, order).alias("_last")))
    carried = F.lag("_last").over(Window.partitionBy(*entity).orderBy(*block))
    crossed = _step(F.col("_carried"), F.col("_first"), before, after).cast("long")
    return (summary.withColumn("_carried", carried)
            .groupBy(*entity)
            .agg(F.sum(F.col("_inner") + F.coalesce(crossed, F.lit(0))).alias("n"))
            .filter(F.col("n") > 0))


def history_blocks(history: DataFrame, entity: Sequence[str], at: str, tie: str, bucket: str = "hour",
                   rows_per_block: int | None = None) -> tuple[DataFrame, list[str]]:
    """``history`` with columns that number the blocks of each entity in order of ``(at, tie)``, and their names.

    A block is a time bucket.  Buckets are counted, and those with more than
    ``rows_per_block`` rows (``ROWS_PER_SLICE``) are cut at quantiles of ``at``; a moment
    that is a quantile itself is a block of its own, which, if still too large, is cut at
    quantiles of ``tie`` (an integer).  Quantiles are approximate, so cutting is repeated
    once; blocks are right wherever they are cut.
    """
    limit = rows_per_block or ROWS_PER_SLICE
    cut, block = history.withColumn("_bucket", F.date_trunc(bucket, F.col(at))), ["_bucket"]
    moment = F.unix_micros(F.col(at).cast("timestamp"))
    whole = history.schema[tie].dataType.typeName() in ("long", "integer", "short", "byte")
    counts = cut.groupBy(*entity, *block).agg(F.count(F.lit(1)).alias("n"))
    facts = counts.agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    if (facts["most"] or 0) <= max(limit, (facts["all"] or 0) / HOT_KEYS):
        return cut, block
    for position, of_moment in ((moment, True), (moment, True), (F.col(tie).cast("long"), False), (F.col(tie).cast("long"), False)):
        if of_moment or whole:
            cut, block = _cut_hot(cut, [*entity, *block], block, position, moment, of_moment, limit)
    return cut, block


def _cut_hot(cut: DataFrame, keys: list[str], block: list[str], position: Column, moment: Column, of_moment: bool,
             limit: int) -> tuple[DataFrame, list[str]]:
    """Cut the large blocks at quantiles of ``position``: between two cuts lies a block, and each cut is one itself.

    Blocks of many moments are cut by moment, those of one by the tie."""
    several = F.coalesce(F.min(moment) < F.max(moment), F.lit(False))
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), several.alias("_several"))
    facts = counts.agg(F.max(F.when(F.col("_several") == of_moment, F.col("_n"))).alias("most"), F.sum("_n").alias("all")).first()
    least = max(limit, (facts["all"] or 0) / HOT_KEYS)
    if (facts["most"] or 0) <= least:
        return cut, block
    most = min(-(-facts["most"] // int(least)) + 1, 1000)
    hot = counts.filter((F.col("_n") > least) & (F.col("_several") == of_moment)).select(
        *[F.col(k).alias(f"_hot{i}") for i, k in enumerate(keys)],
        F.least(F.ceil(F.col("_n") / least) + 1, F.lit(most)).cast("int").alias("_parts"))

    def marked(rows: DataFrame, few: DataFrame, how: str) -> DataFrame:
        same = F.lit(True)
        for i, k in enumerate(keys):
            same = same & rows[k].eqNullSafe(few[f"_hot{i}"])
        return rows.join(F.broadcast(few), same, how)

    shares = [i / most for i in range(1, most)]
    found = marked(cut, hot, "inner").groupBy(*hot.columns).agg(
        F.percentile_approx(position, shares, 10 * most).alias("_all"))
    chosen = F.transform(F.sequence(F.lit(1), F.col("_parts") - 1),
                         lambda i: F.element_at("_all", (i * most / F.col("_parts")).cast("int")))
    ends = found.select(*[c for c in hot.columns if c != "_parts"], F.array_distinct(chosen).alias("_ends"))
    name = f"_cut{len(block)}"
    number = 2 * F.size(F.filter("_ends", lambda e: e < position)) + F.coalesce(F.array_contains("_ends", position), F.lit(False)).cast("int")
    out = marked(cut, ends, "left").withColumn(name, F.when(F.col("_ends").isNull(), 0).otherwise(number)).select(*cut.columns, name)
    return out, [*block, name]


def _step(old: Column, new: Column, before: str, after: str) -> Column:
    return (old == before) & (new == after)


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: str,
                  first: str = "first_seq", counting: Column | None = None) -> DataFrame:
    """Smallest ``order_by`` (among rows ``counting`` holds for) and row count ``n`` per key.

    Combined on the map side; rows with a NULL key belong to no group.
    """
    smallest = F.min(order_by) if counting is None else F.min(F.when(counting, F.col(order_by)))
    return (df.dropna(subset=list(keys))
            .groupBy(*keys)
            .agg(smallest.alias(first), F.count(F.lit(1)).alias("n")))
