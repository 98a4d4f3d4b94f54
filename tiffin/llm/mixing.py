"""Sources mixed to target weights by capped water-filling, built-in functions only.

A source's target is its share of the total by weight, at most ``max_epochs`` times its
size; what a capped source cannot take goes to the others by weight until none is above
its cap.  Clamping in rounds ends where one level times each weight, capped, adds up to
the total, so the level is found at once: sources in order of size over weight are the
order in which they clamp, and running sums over that order give every round's level;
the first level that its source can take is the one (later ones are lower).

A source whose target is r times its size takes every document floor(r) times.  The
rest, less than one epoch, is sampled: documents in the order of a seeded hash are taken
once more while they fit, and the one at the edge is taken in part, so the words taken
differ from the target by less than one word.  Only the slice of hash values that
holds the edge is sorted; the others are counted.

Rows: a null or empty text has size 0 and is taken floor(r) times like the others.
Null is a source of its own, last in order.  Repeated rows are taken one by one.
``doc_id`` and text decide the order, so reruns agree.  Names starting with ``_mix_``
are used inside.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]

WEIGHTS = (5, 2, 1)
#: Words of a text.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2) -> DataFrame:
    """``source, source_size`` with ``target``; one row per source goes in and comes out.

    Weights repeat over the sources in code point order, null last.  ``share`` times all
    sizes is spread.  Sources without words get 0.  Where even all caps are too small,
    every source gets its cap.
    """
    names = Window.orderBy(F.col("source").asc_nulls_last())
    given = F.array(*[F.lit(float(w)) for w in weights])
    rated = sizes.withColumn("_mix_weight", F.get(given, (F.row_number().over(names) - 1) % len(weights))).withColumns({
        "_mix_cap": (F.col("source_size") * max_epochs).cast("double"),
        "_mix_total": F.sum("source_size").over(Window.partitionBy()) * F.lit(share)})
    order = Window.orderBy(F.col("_mix_cap") / F.col("_mix_weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    leveled = rated.withColumn("_mix_level", (
        F.col("_mix_total") - F.coalesce(F.sum("_mix_cap").over(before), F.lit(0.0))) / F.sum("_mix_weight").over(after))
    leveled = leveled.withColumn("_mix_level", F.max(F.when(
        F.col("_mix_level") <= F.col("_mix_cap") / F.col("_mix_weight"), F.col("_mix_level"))).over(Window.partitionBy()))
    target = F.least("_mix_cap", F.coalesce(F.col("_mix_level") * F.col("_mix_weight"), F.col("_mix_cap")))
    return leveled.withColumn("target", target).select("source", "source_size", "target")


def mix(docs: DataFrame, stage: Stage, weights: Sequence[int] = WEIGHTS, share: float = 1.5, max_epochs: int = 2,
        seed: int = 7, slice_digits: int = 4) -> DataFrame:
    """All rows and columns of ``docs`` with ``size``, ``source_size``, ``target``, ``epochs`` (whole
    repetitions), ``taken`` (words, repetitions counted) and ``at_edge`` (its slice holds the edge, so it may
    be taken in part).

    ``slice_digits`` hexadecimal digits of the hash name the slices of a source.
    """
    source = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc_id").cast("string")))
    keyed = docs.withColumns({"_mix_key": key, "_mix_source": source}).withColumn(
        "_mix_slice", F.substring("_mix_key", 1, slice_digits))
    slices = stage(keyed.groupBy("_mix_source", "_mix_slice").agg(F.sum(word_count(F.col("text"))).alias("words")))
    sizes = slices.groupBy("_mix_source").agg(F.sum("words").alias("source_size")).withColumn(
        "source", F.when(~F.col("_mix_source.none"), F.col("_mix_source.name")))
    aims = targets(sizes.select("source", "source_size"), weights, share, max_epochs).withColumns({
        "_mix_source": source,
        "epochs": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")})
    aims = stage(aims.drop("source").withColumn(
        "_mix_rest", F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size")))
    along = Window.partitionBy("_mix_source").orderBy("_mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    cut = (slices.withColumn("_mix_before", F.coalesce(F.sum("words").over(along), F.lit(0).cast("long")))
           .join(aims.select("_mix_source", "_mix_rest"), "_mix_source")
           .filter(F.col("_mix_before") + F.col("words") > F.col("_mix_rest"))
           .groupBy("_mix_source").agg(F.min(F.struct("_mix_slice", "_mix_before")).alias("_mix_edge")))
    # one row per source: documents meet it where they are, so texts are not moved for the decision
    edges = stage(aims.join(cut, "_mix_source", "left"))
    joined = keyed.join(edges, "_mix_source")
    edge = F.col("_mix_edge._mix_slice")
    rows = Window.partitionBy("_mix_source").orderBy("_mix_key", "_mix_size", "_mix_tie").rowsBetween(
        Window.unboundedPreceding, -1)
    # at most one slice per source is ordered
    partial = (joined.filter(F.col("_mix_slice") == edge)
               .withColumns({"_mix_size": word_count(F.col("text")), "_mix_tie": F.xxhash64("text")})
               .withColumn("_mix_extra", F.greatest(F.lit(0).cast("long"), F.least(
                   F.col("_mix_size"), F.col("_mix_rest") - F.col("_mix_edge._mix_before")
                   - F.coalesce(F.sum("_mix_size").over(rows), F.lit(0).cast("long")))))
               .withColumn("at_edge", F.lit(True)))
    others = (joined.filter(edge.isNull() | (F.col("_mix_slice") != edge)).withColumn("_mix_size", word_count(F.col("text")))
              .withColumn("_mix_extra", F.when(edge.isNull() | (F.col("_mix_slice") < edge), F.col("_mix_size"))
                          .otherwise(F.lit(0).cast("long")))
              .withColumn("at_edge", F.lit(False)))
    results = ("size", "source_size", "target", "epochs", "taken", "at_edge")
    names = [F.col(f"`{c}`") for c in docs.columns if c not in results]
    taken = (F.col("epochs") * F.col("_mix_size") + F.col("_mix_extra")).alias("taken")
    parts = [part.select(*names, F.col("_mix_size").alias("size"), "source_size", "target", "epochs", taken, "at_edge")
             for part in (others, partial)]
    return parts[0].unionByName(parts[1])


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: ``columns`` of each document once per whole repetition, and for a part of one the
    leading words of its text joined by one space."""
    whole = F.when(F.col("size") == 0, F.col("epochs")).otherwise(F.floor(F.col("taken") / F.col("size")))
    part = F.when(F.col("size") == 0, 0).otherwise(F.col("taken") % F.col("size"))
    several = mixed.filter(whole > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), whole.cast("int"))))
    cut = mixed.filter(F.col("at_edge") & (part > 0)).withColumn(
        "text", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1), part.cast("int")), " "))
    if "n_chars" in columns:
        cut = cut.withColumn("n_chars", F.char_length("text").cast(dict(mixed.dtypes)["n_chars"]))
    names = [F.col(f"`{c}`") for c in columns]
    return several.select(names).unionByName(cut.select(names))
