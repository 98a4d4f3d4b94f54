"""Row-after-row outcomes of a batch, decided for all rows at once."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.functions.rules import first_error
from tiffin.operators.quality import exists_in, find_duplicates
from tiffin.session import durable


#: Rows of a group of linked requests that one task settles.
FOLD_ROWS = 10_000


def key_name(columns: Sequence[str]) -> str:
    return f"unique_{'_'.join(columns)}"


def first_come(requests: DataFrame, stored: DataFrame, keysets: Sequence[Sequence[str]],
               seq: str = "seq", names: Sequence[str] | None = None, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """``requests`` with ``conflict``: the unique key a row loses to a stored or an earlier accepted row.

    NULL means accepted.  With one key this is a single aggregate.  With several
    a refused row frees the keys it asked for, so outcomes depend on one another
    along shared keys.  Rows that share none are accepted at once.  The others fall
    into groups linked by shared keys (``linked_groups``, rounds that grow with the
    logarithm of a chain's length), and each group of up to ``fold_rows`` rows is
    settled in ``seq`` order by one built-in fold.  Larger groups are settled in
    rounds over the cluster: a row that is first on all of its keys is accepted,
    every row sharing a key with it is refused, the rest go on; one round settles
    any number of rows that ask for one key, and two rows of a chain.  ``stored``
    holds each key once; ``names`` are what the keys are called in ``conflict``.
    """
    names = list(names or [key_name(c) for c in keysets])
    if len(keysets) == 1:
        judged = find_duplicates(requests, stored, keysets[0], seq)
        name = F.when(F.col("stored") | F.col("repeated"), F.lit(names[0]))
        return judged.withColumn("conflict", name).drop("stored", "repeated")

    flags = [f"_stored{i}" for i in range(len(keysets))]
    judged = requests
    for flag, columns in zip(flags, keysets):
        judged = exists_in(judged, stored, {c: c for c in columns}, flag, unique=True)
    held = first_error(*[(F.col(f), name) for f, name in zip(flags, names)])
    judged = durable(judged.withColumn("_held", held).drop(*flags))

    claims = F.array_compact(F.array(*[
        F.when(~reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns]),
               F.struct(F.lit(i).alias("i"), F.to_json(F.struct(*columns)).alias("k")))
        for i, columns in enumerate(keysets)]))
    undecided = durable(judged.filter(F.col("_held").isNull())
                        .select(F.col(seq).alias("_seq"), claims.alias("_claims")))
    long = _claimed(undecided)
    shared = long.groupBy("i", "k").agg(F.min("_seq").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = durable(long.join(shared, ["i", "k"]).filter("_seq <> b").select(F.col("_seq").alias("a"), "b").distinct())
    if links.isEmpty():
        return judged.withColumnRenamed("_held", "conflict")
    groups = linked_groups(links)
    sizes = groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    linked = durable(undecided.join(groups.join(sizes, "group").withColumnRenamed("node", "_seq"), "_seq"))
    refused = _folded(linked.filter(F.col("n") <= fold_rows))
    large = linked.filter(F.col("n") > fold_rows).select("_seq", "_claims")
    open_rows, won = large, []
    while not open_rows.isEmpty():
        decided = durable(_settle(open_rows))
        won.append(decided.filter("won").select("_seq"))
        open_rows = durable(open_rows.join(decided, "_seq", "left_anti"))
    if won:
        refused = refused.unionByName(_first_lost(large, reduce(DataFrame.unionByName, won)))
    texts = F.array(*[F.lit(name) for name in names])
    return (judged.join(refused.withColumnRenamed("_seq", seq), seq, "left")
            .withColumn("conflict", F.coalesce(
                F.col("_held"), F.when(F.col("_lost").isNotNull(), F.get(texts, F.col("_lost")))))
            .select(*requests.columns, "conflict"))


def linked_groups(links: DataFrame) -> DataFrame:
    """``node, group`` of all nodes of ``links`` (a, b): the smallest node that links lead to.

    Every node points at a smaller one or at itself.  A round hooks each node, and what it points at, to the
    smallest second pointer among its neighbours, and shortens its own pointer; pointers double their reach, so a
    chain of n nodes needs about log n rounds, each a few shuffles and two writes to the shared folder.
    """
    both = durable(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    points = durable(both.select(F.col("a").alias("node")).distinct().withColumn("to", F.col("node")))
    while True:
        far = points.select(F.col("node").alias("to"), F.col("to").alias("far"))
        reach = durable(points.join(far, "to").select("node", "to", "far"))
        near = both.join(reach.select(F.col("node").alias("b"), "far"), "b").groupBy(F.col("a").alias("node")).agg(
            F.min("far").alias("near"))
        seen = reach.join(near, "node")
        hooked = seen.groupBy(F.col("to").alias("node")).agg(F.min("near").alias("hook"))
        moved = durable(seen.join(hooked, "node", "left").select(
            "node", F.least("to", "far", "near", "hook").alias("now"), "to"))
        points = moved.select("node", F.col("now").alias("to"))
        if moved.filter("now <> to").isEmpty():
            return points.select("node", F.col("to").alias("group"))


def _folded(linked: DataFrame) -> DataFrame:
    """``(_seq, _lost)`` of the rows refused when each group is gone through in order."""
    rows = F.array_sort(F.collect_list(F.struct("_seq", "_claims")))
    begin = F.struct(F.array().cast("array<struct<i: int, k: string>>").alias("taken"),
                     F.array().cast("array<struct<_seq: bigint, _lost: int>>").alias("lost"))

    def step(state: Column, row: Column) -> Column:
        hit = F.array_min(F.transform(F.filter(row["_claims"], lambda c: F.array_contains(state["taken"], c)), lambda c: c["i"]))
        told = F.struct(row["_seq"].cast("long").alias("_seq"), hit.alias("_lost"))
        return F.struct(F.when(hit.isNull(), F.concat(state["taken"], row["_claims"])).otherwise(state["taken"]).alias("taken"),
                        F.when(hit.isNull(), state["lost"]).otherwise(F.concat(state["lost"], F.array(told))).alias("lost"))

    return (linked.groupBy("group").agg(rows.alias("rows"))
            .select(F.explode(F.aggregate("rows", begin, step)["lost"]).alias("r")).select("r._seq", "r._lost"))


def _settle(undecided: DataFrame) -> DataFrame:
    """One round: ``(_seq, won)`` for the rows that can be decided now."""
    long = _claimed(undecided)
    won = (long.groupBy("i", "k").agg(F.min("_seq").alias("_seq"))
           .groupBy("_seq").agg(F.count(F.lit(1)).alias("_got")))
    winners = (undecided.join(won, "_seq", "left")
               .filter(F.coalesce(F.col("_got"), F.lit(0)) == F.size("_claims"))
               .select("_seq"))
    taken = long.join(winners, "_seq", "left_semi").select("i", "k")
    losers = long.join(winners, "_seq", "left_anti").join(taken, ["i", "k"], "left_semi").select("_seq").distinct()
    return winners.withColumn("won", F.lit(True)).unionByName(losers.withColumn("won", F.lit(False)))


def _claimed(rows: DataFrame) -> DataFrame:
    return rows.select("_seq", F.explode("_claims").alias("_c")).select("_seq", "_c.i", "_c.k")


def _first_lost(rows: DataFrame, winners: DataFrame) -> DataFrame:
    """``(_seq, _lost)`` of the rows that did not win: the first of their keys that an earlier winner holds."""
    long = _claimed(rows)
    held = long.join(winners, "_seq", "left_semi").select(F.col("_seq").alias("_owner"), "i", "k")
    return (long.join(winners, "_seq", "left_anti").join(held, ["i", "k"]).filter(F.col("_owner") < F.col("_seq"))
            .groupBy("_seq").agg(F.min("i").alias("_lost")))
