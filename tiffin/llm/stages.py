"""The stages of the training-data pipeline: rank by quality, drop near copies and repeats, mix, pack.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run`` writes each
result as Parquet to the shared folder and rereads it as the next stage's input, and
then removes what the stage itself had staged.  The quality stage learns from ``labels``
joined with its own input.  All columns of ``documents`` pass through every stage but the
last, which returns the packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.llm import mixing, neardup, packing, quality_ranker, substrings
from tiffin.session import Stage, name_local_dir

#: Documents scored below this go.
LEAST_QUALITY = 0.3

_open: list[Stage] = []


def _staged(spark: SparkSession) -> Stage:
    """Copies a stage works with; ``run`` removes them once the stage's result is written."""
    _open.append(Stage(spark))
    return _open[-1]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    ranker = quality_ranker.train(docs, labels.filter(~quality_ranker.held_out(F.col("doc_id"))))
    return quality_ranker.score(docs, ranker, into="_quality").filter(F.col("_quality") >= LEAST_QUALITY).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of every group of near copies; documents without words stay.

    Rows are told apart by ``doc_id`` and text, so another text under the id of a near copy stays.  Of rows that repeat
    both one stays.  A row without id takes no part: it stays, whatever its text."""
    stage = _staged(spark)
    keyed = docs.withColumn("_near_key", F.xxhash64("text"))
    found = stage(neardup.near_duplicates(docs.select("doc_id", "text"), stage, text_key="_near_key"))
    gone = found.filter("NOT kept").select("doc_id", "_near_key").distinct()
    left = keyed.join(gone, ["doc_id", "_near_key"], "left_anti")
    twice = stage(found.filter("doc_id IS NOT NULL").groupBy("doc_id", "_near_key").count().filter("count > 1").select("doc_id", "_near_key"))
    if not twice.isEmpty():
        once = left.join(twice, ["doc_id", "_near_key"], "left_semi").dropDuplicates(["doc_id", "_near_key"])
        left = left.join(twice, ["doc_id", "_near_key"], "left_anti").unionByName(once)
    return left.select(*docs.columns)


def substring_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that start in an earlier document; what has no word left goes."""
    left = substrings.remove_repeats(docs, _staged(spark)).filter("n_removed = 0 OR n_removed < n_words")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(
            F.char_length("text")).cast(dict(docs.dtypes)["n_chars"]))
    return left.select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources meet their targets."""
    return mixing.repeat(mixing.mix(docs, _staged(spark)), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and offset."""
    made = packing.pieces(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(made, _staged(spark))


STAGES = [
    ("quality classifier", quality),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_repeats),
    ("mixing", mix),
    ("packing", pack),
]

#: Learned scores, sketches and seeded hashes have no SQL; tests compare stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    name_local_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        _open.clear()
        kept = Stage(spark)(step(spark, docs, sf_dir))
        for made in _open:
            made.close()
        docs = kept
    _open.clear()
    return docs
