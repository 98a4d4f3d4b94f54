"""One thin query per operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tiffin.llm import (
    ann,
    byte_bpe,
    hard_negatives,
    mixing,
    neardup,
    oracles,
    packing,
    quality_ranker,
    repair,
    sharding,
    stages,
    substrings,
    token_counts,
    toxicity,
    winnowing,
)
from tiffin.session import Stage, name_local_dir

Query = Callable[[SparkSession, str], DataFrame]

_ROOT = str(Path(__file__).resolve().parents[2])


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _teaching(spark: SparkSession, sf: str, label: str) -> DataFrame:
    """Labels of documents that are not held out."""
    return _table(spark, sf, "labels").select("doc_id", F.col(label).alias("label")).filter(
        ~quality_ranker.held_out(F.col("doc_id")))


def _scored(df: DataFrame, threshold: float) -> DataFrame:
    return df.select("doc_id", quality_ranker.held_out(F.col("doc_id")).alias("held_out"), "score",
                     (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of every text by a unigram model fitted on a sample of them; the model is kept in the shared folder."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    model = token_counts.fit_unigram(token_counts.sample_texts(docs))
    kept = Stage(spark)(spark.createDataFrame([(bytearray(model),)], "model binary"))
    return token_counts.token_counts(docs, bytes(kept.first().model))


def op2_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Bradley-Terry quality score of every document."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return _scored(quality_ranker.score(docs, quality_ranker.train(docs, _teaching(spark, sf, "quality")), ["doc_id"]), 0.3)


def op3_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Largest toxic marginal of every document."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return _scored(toxicity.tag(docs, toxicity.train(docs, _teaching(spark, sf, "toxic")), ["doc_id"]), 0.5)


def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words kept after passages of 50 words that start in an earlier document are removed."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    return substrings.remove_repeats(docs, Stage(spark)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_winnowing(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    return winnowing.edited_fingerprints(_table(spark, sf, "documents"))


def op6_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """A uniform shuffle into 16 shards with row counts at most one apart."""
    rows = _table(spark, sf, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shuffle_into_shards(rows, Stage(spark), 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of at most 4096 tokens by first-fit decreasing."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    made = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=1_600_000)
    return packing.pack(made, Stage(spark))


def op8_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose five-word shingle sets are at least 0.75 alike."""
    return neardup.near_duplicates(_table(spark, sf, "documents").select("doc_id", "text"), Stage(spark))


def op9_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Sources mixed to 150% of all words by weights 5, 2, 1, at most two epochs each."""
    docs = _table(spark, sf, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, Stage(spark)).select("doc_id", "size", "source_size", "target", "taken")


def op10_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth, by inner product."""
    vectors = _table(spark, sf, "embeddings").select("vec_id", "embedding")
    return ann.search(vectors, vectors.filter("vec_id % 20 = 0"), Stage(spark), 20)


def op11_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Byte-level BPE ids of every text, and the bytes they decode to."""
    vocabulary = byte_bpe.Vocabulary.load(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    encoded = byte_bpe.encode(_table(spark, sf, "documents"), vocabulary, ["doc_id"])
    listed = F.array_join(F.col("ids").cast("array<string>"), " ")
    return byte_bpe.decode(encoded, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_repair(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest repair of every damaged conversation."""
    turns = _table(spark, sf, "conversations")
    told = repair.report(repair.damaged(turns), Stage(spark)).withColumnRenamed("conv_id", "_conv")
    every = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(told, every["conv_id"].eqNullSafe(told["_conv"]), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op13_hard_negatives(spark: SparkSession, sf: str) -> DataFrame:
    """Hard negatives of every hundredth vector, where every seventh carries the next label."""
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = _table(spark, sf, "embeddings").select("vec_id", "embedding", shifted.alias("label"))
    return hard_negatives.mine(rows, rows.filter("vec_id % 100 = 0"), Stage(spark))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """All stages of the corpus pipeline."""
    return stages.run(spark, sf)


def _prepared(query: Query) -> Query:
    """Name a staging folder first where a local session has none, and let its Python workers import the library.

    On a cluster the library is shipped with the job (``--py-files``)."""
    @functools.wraps(query)
    def run(spark: SparkSession, sf: str) -> DataFrame:
        name_local_dir(spark)
        known = spark.sparkContext.environment
        known["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([*filter(None, [known.get("PYTHONPATH")]), _ROOT]))
        return query(spark, sf)
    return run


QUERIES: dict[str, Query] = {f.__name__: _prepared(f) for f in (
    op1_token_counts, op2_quality, op3_toxicity, op4_substring_dedup, op5_winnowing, op6_sharding, op7_packing,
    op8_near_duplicates, op9_mixing, op10_neighbours, op11_byte_bpe, op12_conversation_repair, op13_hard_negatives, pipeline,
)}

ORACLES: dict[str, str] = oracles.ORACLES
