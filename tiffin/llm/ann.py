"""Approximate nearest neighbours by multi-index hashing, reranked on the vectors.

Codes: vectors are centred and rotated so that the signs of the coordinates keep as much
of them as possible (iterative quantisation), ``rotations`` times from different starts;
the signs are the code.  Codes are cut into substrings of eight bits.  Two codes within
Hamming distance R agree within floor(R / m) bits in at least one of m substrings, so
probing every substring's lists within that distance retrieves every code within R.
What is retrieved is checked on the whole code and scored on the original vectors.

The index is dealt to shards of about ``shard_rows`` different vectors by hash; each
shard holds its lists and its vectors.  Queries visit every shard in blocks and bring
home their nearest per shard, which are merged.  So no task holds more than a shard
and a block of queries, and what travels is queries times shards.

The rotations and the radius are fitted on a sample of at most ``sample`` vectors
(documented bound): the radius holds ``goal`` of the true nearest of sampled queries
within the sample; with more vectors the true nearest lie closer.  A query that finds
fewer than ``k`` within the radius is asked again without one.

Equal vectors are indexed once with their k + 1 smallest ids: a list of k that leaves
out one id never needs more.  Vectors that are null, zero or hold null or non-finite
components take no part, as a query or a candidate; the most frequent length counts
where lengths differ, and others take no part.  Rows without an id take no part; rows
that repeat an id with equal vectors count once, with different vectors each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Stage = Callable[[DataFrame], DataFrame]

SAMPLE = 8192
SHARD_ROWS = 8192
QUERY_ROWS = 512
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)
_NEAR = _ONES[np.arange(256)[:, None] ^ np.arange(256)[None, :]]


@dataclass
class Codes:
    """Centre and rotations; ``radius`` in bits."""

    centre: np.ndarray
    rotations: np.ndarray
    radius: int

    @property
    def bits(self) -> int:
        return -(-self.rotations.shape[1] // 64) * 64

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Eight bits a byte, whole 64-bit words, one row per vector."""
        packed = np.packbits((vectors - self.centre) @ self.rotations > 0, axis=1)
        return np.pad(packed, ((0, 0), (0, self.bits // 8 - packed.shape[1])))


def learn(vectors: np.ndarray, k: int, rotations: int = 2, rounds: int = 30, goal: float = 0.95, seed: int = 7) -> Codes:
    """Fit rotations and radius on a sample."""
    rng = np.random.default_rng(seed)
    size = vectors.shape[1]
    width = -(-size // 8) * 8
    centre = vectors.mean(axis=0)
    _, _, axes = np.linalg.svd(vectors - centre, full_matrices=False)
    base = np.zeros((size, width))
    base[:, :len(axes)] = axes.T
    reduced = (vectors - centre) @ base
    made = []
    for _ in range(rotations):
        turn, _ = np.linalg.qr(rng.standard_normal((width, width)))
        for _ in range(rounds):
            left, _, right = np.linalg.svd(np.where(reduced @ turn > 0, 1.0, -1.0).T @ reduced)
            turn = (left @ right).T
        made.append(base @ turn)
    codes = Codes(centre, np.hstack(made), 0)
    packed = codes.encode(vectors)
    asked = rng.permutation(len(vectors))[:256]
    scores = vectors[asked] @ vectors.T
    scores[np.arange(len(asked)), asked] = -np.inf
    nearest = np.argsort(-scores, axis=1)[:, :min(k, max(len(vectors) - 1, 1))]
    distance = np.array([_ONES[packed[n] ^ packed[q]].sum(axis=1) for q, n in zip(asked, nearest, strict=True)])
    codes.radius = int(np.quantile(distance, goal)) if distance.size else codes.bits
    return codes


class Shard:
    """Vectors of one shard with the places of each value of each substring, as bitmaps.

    What a probe of a substring retrieves, the lists of all values within reach of the asked
    one, is put together when it is first asked for and kept; there are 256 such unions per
    substring at most, so a shard's index is bounded by its rows.
    """

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], codes: np.ndarray, radius: int):
        self.vectors, self.ids, self.radius = vectors, ids, radius
        self.words = codes.copy().view(np.uint64)
        self.reach = radius // codes.shape[1]
        self.lists = []
        for column in codes.T:
            marks = np.zeros((256, len(codes)), dtype=bool)
            marks[column, np.arange(len(codes))] = True
            self.lists.append(np.packbits(marks, axis=1))
        self.probes: dict[tuple[int, int], np.ndarray] = {}

    def _probe(self, j: int, value: int) -> np.ndarray:
        found = self.probes.get((j, value))
        if found is None:
            found = np.bitwise_or.reduce(self.lists[j][_NEAR[value] <= self.reach], axis=0)
            self.probes[j, value] = found
        return found

    def within(self, code: np.ndarray) -> np.ndarray:
        """Places of all codes within the radius of ``code``: in reach in some substring, then on the whole code."""
        hit = self._probe(0, int(code[0])).copy()
        for j, value in enumerate(code[1:].tolist(), 1):
            hit |= self._probe(j, value)
        found = np.flatnonzero(np.unpackbits(hit, count=len(self.vectors)))
        away = np.bitwise_count(self.words[found] ^ code.copy().view(np.uint64)).sum(axis=1, dtype=np.int64)
        return found[away <= self.radius]


def _usable(vectors: DataFrame, vec: str) -> DataFrame:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    return vectors.filter(F.col(vec).isNotNull()).filter(~bad & some)


def search(vectors: DataFrame, queries: DataFrame, stage: Stage, k: int = 20, sample: int = SAMPLE,
           shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS, seed: int = 7) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of ``vectors`` (vec_id, embedding) to each query
    (the same columns) by inner product, without the query's own id; ties go to the smaller id."""
    def clean(df: DataFrame) -> DataFrame:
        return _usable(df.select(F.col("vec_id").cast("long").alias("vec_id"),
                                 F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id IS NOT NULL"), "embedding")

    usable = clean(vectors)
    lengths = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    usable = usable.filter(F.size("embedding") == lengths.n)
    key = F.xxhash64("embedding")
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    classes = stage(usable.distinct().withColumn("place", F.row_number().over(smallest)).filter(F.col("place") <= k + 1)
                    .groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    count = classes.count()
    taken = classes.select("embedding").orderBy(key).limit(sample).toPandas()
    codes = learn(np.array(taken["embedding"].tolist()), k, seed=seed)
    shards = max(1, -(-count // shard_rows))
    index = classes.select(F.pmod(key, F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("long").alias("query"),
                           "embedding", "ids")
    asked = stage(clean(queries).filter(F.size("embedding") == lengths.n).select("embedding").distinct().withColumn(
        "query", F.monotonically_increasing_id()))

    def ask(questions: DataFrame, radius: int) -> DataFrame:
        """The nearest within the radius, k + 1 of different classes at most per question and shard."""
        visits = questions.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "query", "embedding",
                                  F.lit(None).cast("array<bigint>").alias("ids"))
        dealt = index.unionByName(visits).repartition("shard").sortWithinPartitions("shard", F.col("query").asc_nulls_first())
        return dealt.mapInArrow(lambda it: _visit(it, codes, radius, k, query_rows),
                                "query long, ids array<long>, score double")

    def best(found: DataFrame) -> DataFrame:
        """Expand the ids and rank them per question; a question keeps one id more, as its own may be among them."""
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return (found.withColumn("vec_id", F.explode("ids")).withColumn("rank", F.row_number().over(order))
                .filter(F.col("rank") <= k + 1).select("query", "vec_id", "score"))

    first = stage(best(ask(asked, codes.radius)))
    few = asked.join(first.groupBy("query").count().filter(F.col("count") > k), "query", "left_anti")
    first = first.join(few.select("query"), "query", "left_anti").unionByName(best(ask(few, codes.bits)))
    own = (clean(queries).filter(F.size("embedding") == lengths.n)
           .select(F.col("vec_id").alias("query_id"), "embedding").distinct().join(asked, "embedding").drop("embedding"))
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (own.join(first, "query").filter(F.col("vec_id") != F.col("query_id"))
            .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def _visit(batches: Iterator[pa.RecordBatch], codes: Codes, radius: int, k: int, query_rows: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive shard by shard, the shard's vectors before its questions."""
    current, index, shard = None, [], None

    def answer(queries: list[int], questions: np.ndarray) -> pa.RecordBatch:
        owner: list[int] = []
        places: list[np.ndarray] = []
        scores: list[np.ndarray] = []
        for query, question, code in zip(queries, questions, codes.encode(questions), strict=True):
            found = shard.within(code)
            score = np.einsum("ij,j->i", shard.vectors[found], question)
            if len(found) > k + 1:
                kept = score >= np.partition(score, -(k + 1))[-(k + 1)]
                found, score = found[kept], score[kept]
            owner += [query] * len(found)
            places.append(found)
            scores.append(score)
        at = np.concatenate(places).tolist()
        return pa.RecordBatch.from_arrays([
            pa.array(owner, pa.int64()), pa.array([shard.ids[p] for p in at], pa.list_(pa.int64())),
            pa.array(np.concatenate(scores), pa.float64())], names=["query", "ids", "score"])

    for batch in batches:
        if not batch.num_rows:
            continue
        numbers, queries = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        flat = np.stack(batch.column(2).to_numpy(zero_copy_only=False))
        ids = batch.column(3).to_pylist()
        waiting: list[int] = []
        for i, (number, query) in enumerate(zip(numbers, queries, strict=True)):
            if number != current:
                if waiting:
                    yield answer([queries[w] for w in waiting], flat[waiting])
                    waiting = []
                current, index, shard = number, [], None
            if query is None:
                index.append((flat[i], ids[i]))
                continue
            if shard is None:
                if not index:
                    continue
                own = np.array([v for v, _ in index])
                shard, index = Shard(own, [x for _, x in index], codes.encode(own), radius), []
            waiting.append(i)
            if len(waiting) >= query_rows:
                yield answer([queries[w] for w in waiting], flat[waiting])
                waiting = []
        if waiting:
            yield answer([queries[w] for w in waiting], flat[waiting])
