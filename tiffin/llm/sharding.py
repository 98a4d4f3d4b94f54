"""A uniform shuffle into shards of exact size, with a hypergeometric communication matrix.

1. Rows are permuted inside their partition by a seeded hash and numbered (no exchange).
2. How many rows of partition p go to shard q is drawn, exactly as a uniform shuffle of
   all rows would have it: rows of the matrix sum to the partitions' sizes, columns to
   the shards' sizes.  Each draw is hypergeometric given the earlier ones.
3. Each partition deals its first rows to shard 0, the next to shard 1 and so on; rows
   move once.
4. Every shard is permuted again: a second hash ranks its rows, in slices counted first,
   so that no task sorts a whole shard.

Built-in functions only.  The matrix is drawn by an SQL expression, for groups of
partitions first and then inside each group, so no row of it handles more than
``group`` partitions.  Hashes depend on the seed and on the row's place in the staged
table, so a lost executor's rows are dealt again in the same way, repeated rows are
told apart, and a hot key has no part in it.  Empty tables give no rows; nulls in any column are data.
Columns named ``_shard_...`` are used inside.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]

#: Partitions that one row of the matrix computation handles.
GROUP = 512
#: Rows that one task ranks, about.
SLICE_ROWS = 1 << 20


def uniform(seed: int, *names: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the given columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11) / F.lit(float(1 << 53))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def hypergeometric(total: Column, good: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` rows out of ``total``, of which ``good`` are good, are good: the
    inverse of the distribution at ``u``.

    Weights are taken relative to the mode, from there outwards to both sides as far as
    they matter (twelve standard deviations), so nothing underflows at any size.
    """
    def grow(x: Column, k: Column) -> Column:
        """weight(k) / weight(k - 1)"""
        return ((x["good"] - k + 1).cast("double") * (x["drawn"] - k + 1)
                / (k.cast("double") * (x["total"] - x["good"] - x["drawn"] + k)))

    def walk(steps: Column, ratio: Callable[[Column], Column]) -> Column:
        start = F.struct(F.lit(1.0).alias("weight"), F.lit(0.0).alias("sum"))
        return F.aggregate(steps, start, lambda s, k: let(s["weight"] * ratio(k), lambda w: F.struct(
            w.alias("weight"), (s["sum"] + w).alias("sum"))))["sum"]

    def take(steps: Column, left: Column, pick: Column, ratio: Callable[[Column], Column], shift: int) -> Column:
        start = F.struct(F.lit(1.0).alias("weight"), left.alias("left"), pick.alias("pick"))
        return F.aggregate(steps, start, lambda s, k: F.when(s["pick"].isNotNull(), s).otherwise(
            let(s["weight"] * ratio(k), lambda w: F.struct(
                w.alias("weight"), (s["left"] - w).alias("left"),
                F.when(s["left"] < w, k + F.lit(shift)).cast("long").alias("pick")))))

    def around(x: Column) -> Column:
        low = F.greatest(F.lit(0).cast("long"), x["drawn"] + x["good"] - x["total"])
        high = F.least(x["drawn"], x["good"])
        mode = F.floor((x["drawn"] + 1).cast("double") * (x["good"] + 1) / (x["total"] + 2)).cast("long")
        spread = F.sqrt(x["drawn"] * (x["good"] / x["total"]) * (1 - x["good"] / x["total"])
                        * (x["total"] - x["drawn"]) / F.greatest(x["total"] - 1, F.lit(1)))
        return F.struct(low.alias("low"), high.alias("high"), F.least(high, F.greatest(low, mode)).alias("mode"),
                        (12 * spread + 12).cast("long").alias("reach"))

    def pick(x: Column) -> Column:
        none = F.array().cast("array<bigint>")
        up = let(around(x), lambda a: F.when(F.least(a["high"], a["mode"] + a["reach"]) > a["mode"], F.sequence(
            a["mode"] + 1, F.least(a["high"], a["mode"] + a["reach"]))).otherwise(none))
        down = let(around(x), lambda a: F.when(a["mode"] > F.greatest(a["low"], a["mode"] - a["reach"]), F.sequence(
            a["mode"], F.greatest(a["low"], a["mode"] - a["reach"]) + 1)).otherwise(none))

        def choose(v: Column) -> Column:
            aim = x["u"] * (1 + walk(v["up"], lambda k: grow(x, k)) + walk(v["down"], lambda k: 1 / grow(x, k)))
            start = let(aim, lambda y: F.struct((y - 1).alias("left"), F.when(y < 1, v["mode"]).alias("pick")))
            above = let(start, lambda s: take(v["up"], s["left"], s["pick"], lambda k: grow(x, k), 0))
            below = let(above, lambda s: take(v["down"], s["left"], s["pick"], lambda k: 1 / grow(x, k), -1))
            return F.coalesce(below["pick"], v["mode"])

        return let(F.struct(up.alias("up"), down.alias("down"), around(x)["mode"].alias("mode")), choose)

    given = F.struct(total.cast("long").alias("total"), good.cast("long").alias("good"),
                     drawn.cast("long").alias("drawn"), u.alias("u"))
    return let(given, lambda x: F.when((x["good"] == 0) | (x["drawn"] == 0), F.lit(0).cast("long"))
               .when(x["good"] == x["total"], x["drawn"]).otherwise(pick(x)))


def deal(listed: DataFrame, seed: int) -> DataFrame:
    """Draw the matrix of each row ``key, parts array<struct<part, rows>>, want array<long>``.

    ``want`` says how many rows each shard takes and adds up to the parts' rows.  Returns
    ``key, part, rows, counts``.  Shards are served one after another; one shard's rows are
    spread over the parts one part at a time, given what is left of each.
    """
    none = F.array().cast("array<bigint>")

    def serve(state: Column, want: Column) -> Column:
        start = F.struct(F.aggregate(state["left"], F.lit(0).cast("long"), lambda s, x: s + x).alias("total"),
                         want.alias("drawn"), none.alias("taken"))

        def one(s: Column, x: Column) -> Column:
            u = uniform(seed, F.col("key"), F.size(state["done"]), F.size(s["taken"]))
            return let(hypergeometric(s["total"], x, s["drawn"], u), lambda n: F.struct(
                (s["total"] - x).alias("total"), (s["drawn"] - n).alias("drawn"),
                F.concat(s["taken"], F.array(n)).alias("taken")))

        return let(F.aggregate(state["left"], start, one)["taken"], lambda taken: F.struct(
            F.zip_with(state["left"], taken, lambda x, n: x - n).alias("left"),
            F.concat(state["done"], F.array(taken)).alias("done")))

    begin = F.struct(F.transform("parts", lambda p: p["rows"]).alias("left"),
                     F.array().cast("array<array<bigint>>").alias("done"))
    drawn = listed.withColumn("done", F.aggregate("want", begin, serve)["done"])
    return drawn.select("key", "done", F.posexplode("parts").alias("at", "p")).select(
        "key", "p.part", "p.rows", F.transform("done", lambda taken: F.get(taken, F.col("at"))).alias("counts"))


def communication_matrix(sizes: DataFrame, stage: Stage, shards: int, seed: int, group: int = GROUP) -> DataFrame:
    """``part, counts`` (rows for each shard) for partitions ``part, rows``; shards differ by one row at most."""
    grouped = sizes.withColumn("key", F.floor(F.col("part") / group).cast("long"))
    members = F.array_sort(F.collect_list(F.struct("part", "rows"))).alias("parts")
    upper = (grouped.groupBy(F.col("key").alias("part")).agg(F.sum("rows").alias("rows")).agg(members)
             .withColumn("total", F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["rows"]))
             .select(F.lit(-1).cast("long").alias("key"), "parts", F.transform(
                 F.sequence(F.lit(0), F.lit(shards - 1)),
                 lambda q: (F.floor(F.col("total") / shards) + F.when(F.col("total") % shards > q, 1).otherwise(0))
                 .cast("long")).alias("want")).filter(F.size("parts") > 0))
    quotas = stage(deal(upper, seed)).select(F.col("part").alias("key"), F.col("counts").alias("want"))
    return deal(grouped.groupBy("key").agg(members).join(quotas, "key"), seed).select("part", "counts")


def shuffle_into_shards(df: DataFrame, stage: Stage, shards: int = 16, seed: int = 7, group: int = GROUP,
                        slice_rows: int = SLICE_ROWS) -> DataFrame:
    """All rows and columns of ``df`` with ``shard`` (0 ..) and ``slot`` (gapless from 0 in each shard),
    which replace columns of their names."""
    df = df.drop("shard", "slot")
    low = F.lit((1 << 33) - 1)
    local = stage(df.withColumn("_shard_key", F.xxhash64(F.lit(seed), F.lit("local"), F.monotonically_increasing_id()))
                  .sortWithinPartitions("_shard_key")
                  .withColumn("_shard_part", F.spark_partition_id().cast("long"))
                  .withColumn("_shard_at", F.monotonically_increasing_id().bitwiseAND(low)).drop("_shard_key"))
    sizes = stage(local.groupBy(F.col("_shard_part").alias("part")).agg(F.count("*").alias("rows")))
    ends = stage(communication_matrix(sizes, stage, shards, seed, group).select(
        F.col("part").alias("_shard_part"), F.transform(
            F.sequence(F.lit(1), F.size("counts")), lambda i: F.aggregate(
                F.slice("counts", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x)).alias("_shard_ends")))
    total = local.count()
    bits = max(4, (total // (shards * slice_rows)).bit_length())
    dealt = local.join(ends, "_shard_part").withColumns({
        "shard": F.size(F.filter("_shard_ends", lambda e: e <= F.col("_shard_at"))),
        "_shard_key": F.xxhash64(F.lit(seed), F.lit("shard"), "_shard_part", "_shard_at")}).withColumn(
        "_shard_slice", F.shiftrightunsigned("_shard_key", 64 - bits))
    before = (Window.partitionBy("shard").orderBy("_shard_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = stage(dealt.groupBy("shard", "_shard_slice").agg(F.count("*").alias("n")).withColumn(
        "_shard_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("shard", "_shard_slice").orderBy("_shard_key", "_shard_part", "_shard_at")
    return (dealt.join(slices, ["shard", "_shard_slice"])
            .withColumn("slot", F.row_number().over(inside) - 1 + F.col("_shard_before"))
            .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot"))
