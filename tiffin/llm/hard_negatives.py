"""Hard negatives of anchors, by rotated one-bit codes whose error is bounded for certain.

Vectors become integers, ``floor(256 * x)``, and scores are integer inner products.  Each
vector o is rotated into ``bits`` dimensions (an orthonormal frame from ``seed``), where the
signs of its coordinates are its code: the corner x of a cube, seen in the vectors' own
space as the direction u.  Stored with the code is the alignment a = <o, u>, and what it
leaves: rest = sqrt(|o|^2 - a^2).  A question q is rotated too and rounded to seven bit
planes, so <u, q> comes from popcounts of code and planes, up to a known rounding error.
As o = a u + r with r at right angles to u, Cauchy-Schwarz gives for certain

    | <o, q> - a <u, q> | <= rest * sqrt(|q|^2 - <u, q>^2).

Only vectors whose interval can still reach the wanted scores are scored, as integers; so
results are exact.  ``bits`` above the dimension narrow the intervals.

The table is dealt to shards of about ``shard_rows`` vectors by hash: for positives by
label and hash, so a question visits the shards of its label; for negatives by hash alone.
Questions travel to the shards (a stated part of the table against all of it); each brings
home its best few per shard, which are merged by question.  No task holds more than a
shard and a batch of questions, whatever label, vector or id is frequent.

Rows: those with a null id, label or vector, or a null or non-finite component take no
part; where lengths differ, only the most frequent (the smaller of equals) does.  Floored
components are held within 2**24, so sums fit a long.  Repeated rows count once; rows of
one id with different vectors or labels each by themselves, but never for one another.
Empty vectors and empty tables give nothing.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tiffin.llm import words as W

Stage = Callable[[DataFrame], DataFrame]

BITS = 512
PLANES = 7
SHARD_ROWS = 16_384
_MOST = 1 << 24


@dataclass
class Frame:
    """The rotation of ``size`` dimensions into ``bits``; columns are orthonormal."""

    size: int
    bits: int
    seed: int = 7

    def rotation(self) -> np.ndarray:
        made, _ = np.linalg.qr(np.random.default_rng(self.seed).standard_normal((self.bits, self.size)))
        return made

    def encode(self, vectors: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes as bytes, alignment, what it leaves, and the factor from popcounts to <u, q>."""
        positive = vectors @ rotation.T > 0
        corner = np.where(positive, 1.0, -1.0) / np.sqrt(self.bits)
        seen = corner @ rotation
        length = np.sqrt((seen ** 2).sum(axis=1))
        length = np.where(length > 0, length, 1.0)
        align = (vectors * seen).sum(axis=1) / length
        rest = np.sqrt(np.maximum((vectors.astype(np.float64) ** 2).sum(axis=1) - align ** 2, 0))
        return np.packbits(positive, axis=1), align, rest, 1 / (length * np.sqrt(self.bits))


@dataclass
class Shard:
    """Vectors with their codes; ``bounds`` gives an interval around every score of a question."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    words: np.ndarray
    align: np.ndarray
    rest: np.ndarray
    factor: np.ndarray

    def bounds(self, question: np.ndarray, rotated: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and the largest that each vector's inner product with ``question`` can be."""
        largest = float(np.abs(rotated).max()) or 1.0
        unit = 2 * largest / ((1 << PLANES) - 1)
        rounded = np.rint((rotated + largest) / unit).astype(np.uint8)
        miss = float(np.sqrt(((rounded * unit - largest - rotated) ** 2).sum()))
        sums = np.zeros(len(self.ids), dtype=np.int64)
        for plane in range(PLANES):
            bits = np.packbits(rounded >> plane & 1).view(np.uint64)
            sums += np.bitwise_count(self.words & bits[:, None]).sum(axis=0, dtype=np.int64) << plane
        set_bits = self.set_bits()
        # sum over set bits less sum over clear bits, of rounded * unit - largest
        signed = unit * (2.0 * sums - int(rounded.sum())) - largest * (2.0 * set_bits - len(rotated))
        along = signed * self.factor
        wrong = miss * self.factor * np.sqrt(len(rotated))
        length = float((question.astype(np.float64) ** 2).sum())
        across = np.sqrt(np.maximum(length - np.maximum(np.abs(along) - wrong, 0) ** 2, 0))
        width = self.align * wrong + self.rest * across
        width = width * (1 + 1e-9) + 1e-9 * (self.align + self.rest) * np.sqrt(length) + 1e-6
        middle = self.align * along
        return middle - width, middle + width

    def set_bits(self) -> np.ndarray:
        if not hasattr(self, "_set_bits"):
            self._set_bits = np.bitwise_count(self.words).sum(axis=0, dtype=np.int64)
        return self._set_bits


class Scores:
    """Integer scores of one question, computed where they are asked for."""

    def __init__(self, shard: Shard, question: np.ndarray, rotated: np.ndarray):
        self.shard, self.question = shard, question
        self.low, self.high = shard.bounds(question, rotated)
        self.exact = np.zeros(len(shard.ids), dtype=np.int64)
        self.known = np.zeros(len(shard.ids), dtype=bool)

    def ask(self, at: np.ndarray) -> np.ndarray:
        new = at[~self.known[at]]
        if len(new):
            self.exact[new] = self.shard.vectors[new] @ self.question
            self.known[new] = True
        return self.exact[at]

    def best(self, allowed: np.ndarray, k: int, least: int | None = None, most: int | None = None) -> np.ndarray:
        """Places of the ``k`` largest scores between the limits, ties to smaller ids."""
        if least is not None:
            allowed = allowed & (self.high >= least) & (self.low <= most)
        at = np.flatnonzero(allowed)
        if len(at) > 4 * k:
            guess = (self.low[at] + self.high[at]) / 2
            if most is not None:
                guess = np.where(guess <= most, guess, -np.inf)
            first = at[np.argpartition(-guess, 4 * k)[:4 * k]]
            found = self.ask(first)
            if least is not None:
                found = found[(found >= least) & (found <= most)]
            if len(found) >= k:
                at = at[self.high[at] >= np.partition(found, -k)[-k]]
        found = self.ask(at)
        if least is not None:
            inside = (found >= least) & (found <= most)
            at, found = at[inside], found[inside]
        return at[np.lexsort((self.shard.ids[at], -found))[:k]]


def usable(rows: DataFrame) -> DataFrame:
    """``vec_id, label, vec``: distinct integer vectors with an id and a label."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.least(F.greatest(
        F.floor(F.least(F.greatest(256 * x, F.lit(-1e9)), F.lit(1e9))), F.lit(-_MOST)), F.lit(_MOST)).cast("int"))
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
            .filter("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0").filter(~bad)
            .select("vec_id", "label", whole.alias("vec")).distinct())


def _numbers(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


def _encoded(rows: DataFrame, frame: Frame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = frame.rotation()
        for batch in batches:
            for begin in range(0, batch.num_rows, 2048):
                part = batch.slice(begin, 2048)
                code, align, rest, factor = frame.encode(_numbers(part.column(2), frame.size), rotation)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([c.tobytes() for c in code], pa.binary()), *map(pa.array, (align, rest, factor))],
                    names=[*part.schema.names, "code", "align", "rest", "factor"])

    return rows.mapInArrow(W.lean(run), "vec_id long, label int, vec array<int>, code binary, align double, rest double, factor double")


_FIELDS = ("_shard", "_asked", "vec_id", "label", "vec", "code", "align", "rest", "factor", "positives")


def _met(index: DataFrame, visits: DataFrame, shards: int, frame: Frame, answer: Callable, schema: str) -> DataFrame:
    """``answer(shard, scores, question's row)`` rows of every question at every shard it visits.

    Rows arrive shard by shard, the shard's vectors before its questions; the number of partitions is that of the shards."""
    fields = list(_FIELDS)
    nothing = {"_asked": "long", "positives": "array<struct<id: bigint, score: bigint>>"}
    kept = {"code": "binary", "align": "double", "rest": "double", "factor": "double"}
    dealt = (index.withColumns({c: F.lit(None).cast(t) for c, t in nothing.items()}).select(*fields)
             .unionByName(visits.withColumns({c: F.lit(None).cast(t) for c, t in kept.items()}).select(*fields))
             .repartition(shards, "_shard").sortWithinPartitions("_shard", F.col("_asked").asc_nulls_first()))

    def build(parts: list[pa.RecordBatch]) -> Shard:
        columns = {n: pa.chunked_array([p.column(i) for p in parts]).combine_chunks() for i, n in enumerate(_FIELDS[:9])}
        codes = np.frombuffer(b"".join(columns["code"].to_pylist()), dtype=np.uint64).reshape(-1, frame.bits // 64)
        plain = [columns[n].to_numpy(zero_copy_only=False) for n in ("vec_id", "label", "align", "rest", "factor")]
        return Shard(plain[0], plain[1], _numbers(columns["vec"], frame.size), codes.T.copy(), *plain[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation = frame.rotation()
        number, parts, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            asks = np.asarray(batch.column(1).is_valid())
            edges = np.flatnonzero((key[1:] != key[:-1]) | (asks[1:] != asks[:-1])) + 1
            out: list[tuple] = []
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(key)], strict=True):
                if key[begin] != number:
                    number, parts, shard = key[begin], [], None
                part = batch.slice(begin, end - begin)
                if not asks[begin]:
                    parts.append(part)
                    continue
                if shard is None:
                    if not parts:
                        continue
                    shard, parts = build(parts), []
                vectors = _numbers(part.column(4), frame.size)
                rows = zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(),
                           part.column(9).to_pylist(), vectors, vectors @ rotation.T, strict=True)
                for asked, own, label, positives, vector, rotated in rows:
                    out += answer(shard, Scores(shard, vector, rotated), asked, own, label, positives)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    names = [f.split()[0] for f in schema.split(", ")]
    return dealt.mapInArrow(W.lean(run), schema)


def mine(rows: DataFrame, anchors: DataFrame, stage: Stage, positives: int = 5, k: int = 10, low: int = 30, high: int = 90,
         bits: int = BITS, shard_rows: int = SHARD_ROWS, seed: int = 7) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``rows`` and ``anchors`` have ``vec_id, label, embedding``.  An anchor's positives are its first ``positives`` other
    rows of its label by score (ties: smaller id); the negatives of a positive the first ``k`` rows of other labels with
    ``low * positive_score <= 100 * negative_score <= high * positive_score``."""
    spark = rows.sparkSession
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    clean = stage(usable(rows))
    common = clean.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], shape)
    frame = Frame(common.n, -(-max(bits, common.n) // 64) * 64, seed)
    index = stage(_encoded(clean.filter(F.size("vec") == common.n), frame))
    asked = stage(usable(anchors).filter(F.size("vec") == common.n).withColumn("_asked", F.monotonically_increasing_id()))

    place = F.xxhash64("vec_id", "vec")
    labels = stage(index.groupBy("label").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("_splits")))
    count = labels.agg(F.sum("_splits")).first()[0]
    own = index.join(labels, "label").withColumn("_shard", F.xxhash64("label", F.pmod(place, F.col("_splits")))).drop("_splits")
    visits = asked.join(labels, "label").withColumn("_split", F.explode(F.sequence(F.lit(0), F.col("_splits") - 1)))
    visits = visits.withColumns({"_shard": F.xxhash64("label", F.col("_split").cast("long")),
                                 "positives": F.lit(None).cast("array<struct<id: bigint, score: bigint>>")})

    def alike(shard: Shard, scores: Scores, number: int, anchor: int, label: int, _) -> Iterator[tuple]:
        at = scores.best((shard.labels == label) & (shard.ids != anchor), positives)
        return zip([number] * len(at), shard.ids[at].tolist(), scores.ask(at).tolist(), strict=True)

    best = Window.partitionBy("_asked").orderBy(F.desc("score"), "id")
    found = _met(own, visits, count, frame, alike, "_asked long, id long, score long").withColumn(
        "place", F.row_number().over(best)).filter(F.col("place") <= positives)
    kept = stage(asked.join(found.groupBy("_asked").agg(F.collect_list(F.struct("id", "score")).alias("positives")), "_asked"))

    shards = max(1, -(-index.count() // shard_rows))
    dealt = index.withColumn("_shard", F.pmod(place, F.lit(shards)))
    visits = kept.withColumn("_shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))

    def unlike(shard: Shard, scores: Scores, number: int, anchor: int, label: int, known: list[dict]) -> list[tuple]:
        allowed = (shard.labels != label) & (shard.ids != anchor)
        out: list[tuple] = []
        for positive in known:
            least, most = -(-low * positive["score"] // 100), high * positive["score"] // 100
            if least <= most:
                at = scores.best(allowed, k, least, most)
                out += zip([number] * len(at), [positive["id"]] * len(at), [positive["score"]] * len(at),
                           shard.ids[at].tolist(), scores.ask(at).tolist(), strict=True)
        return out

    order = Window.partitionBy("_asked", "positive_id", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    negatives = _met(dealt, visits, shards, frame, unlike,
                     "_asked long, positive_id long, positive_score long, negative_id long, negative_score long")
    ranked = negatives.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(kept.select("_asked", F.col("vec_id").alias("anchor_id")), "_asked").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
