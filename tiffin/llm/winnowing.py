"""Document fingerprints by winnowing.

Every ``k`` consecutive code points are hashed by a rolling polynomial.  In each window
of ``window`` consecutive hashes the smallest is chosen, the rightmost one if several are
equal, and kept with its position.  Any passage of at least ``window + k - 1`` code points
that two texts share is then chosen in both at the same place, and no passage shorter
than ``k`` counts.  A text with fewer hashes than a window has the smallest of all; one
shorter than ``k`` has the hash of its whole; an empty one has none.

A fingerprint is written as text: per choice, in order of position, eight hexadecimal
digits of the hash, ``@`` and the position; choices are separated by a space.  Likeness
is the Jaccard similarity of the chosen hashes, 1 for two empty fingerprints.

``neighbours`` pairs every text with the next one in descending ``doc_id`` in one
exchange: ids are cut into ranges, each range is sorted once, and the first row of a
range also travels to the range before it.  Nothing is gathered per range; a task holds
one row besides its batch.

Rows: a null text counts as empty.  Rows of one ``doc_id`` follow one another in the
order of their text; rows without ``doc_id`` come last.  After the last row comes the
first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm.words import BASES, mix, powers

#: Code points per hash and hashes per window: 15 shared code points are always found, so a text of 30
#: that keeps its first half keeps a hash.
K, WINDOW = 8, 8
#: Code points of texts after which their fingerprints are sent on.
SENT = 1 << 20
#: Bytes of text per range, about; ranges at most (their bounds and first ids are broadcast).
RANGE_BYTES = 32 << 20
RANGES = 20_000
_LOW32 = np.uint64(0xFFFFFFFF)


def winnow(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (32 bits) and positions chosen from the code points of a text."""
    if len(points) == 0:
        return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    k = min(k, len(points))
    up, down = powers(BASES[0], len(points) + 1)
    total = np.zeros(len(points) + 1, dtype=np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    hashes = mix((total[k:] - total[:-k]) * down[:len(points) - k + 1] + np.uint64(k)) & ~_LOW32
    # The low half counts down, so that of equal hashes the rightmost is the smallest value.
    ranked = hashes | (_LOW32 - np.arange(len(hashes), dtype=np.uint64))
    if len(ranked) <= window:
        chosen = ranked[[ranked.argmin()]]
    else:
        span, least = 1, ranked
        while 2 * span <= window:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        n = len(ranked) - window + 1
        least = np.minimum(least[:n], least[window - span:window - span + n])
        chosen = least[np.append(True, least[1:] != least[:-1])]
    return (chosen >> np.uint64(32)).astype(np.uint32), (_LOW32 - (chosen & _LOW32)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def write(hashes: np.ndarray, positions: np.ndarray) -> str:
    return " ".join([f"{h:08x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist(), strict=True)])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    one, other = set(a.tolist()), set(b.tolist())
    return len(one & other) / len(one | other) if one or other else 1.0


def fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """``doc_id`` with ``hashes`` and ``positions`` (lists) and ``fingerprint`` for each row of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 100) for b in batches for i in range(0, b.num_rows, 100)):
            made = [winnow(code_points(t or ""), k, window) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([h.astype(np.int64) for h, _ in made], pa.list_(pa.int64())),
                pa.array([p for _, p in made], pa.list_(pa.int64())), pa.array([write(*m) for m in made], pa.string())],
                names=["doc_id", "hashes", "positions", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, hashes array<long>, positions array<long>, fingerprint string")


def neighbours(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``docs`` (doc_id, text) dealt to sorted ranges of descending id, as ``part, guest, doc_id, text``.

    A guest is the first row of the next range, there only to be the last row's next.
    ``ranges`` defaults to one per ``RANGE_BYTES`` of text.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", key).withColumn(
        "place", F.negate(F.col("key").cast("double")))
    if ranges is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = min(RANGES, max(size // RANGE_BYTES, spark.sparkContext.defaultParallelism))
    firsts = sorted({r.first for r in keyed.select("place").repartitionByRange(ranges, "place").groupBy(
        F.spark_partition_id().alias("part")).agg(F.min("place").alias("first")).collect()})
    inf = float("inf")
    cut = Bucketizer(splits=[-inf, *([firsts[1:], firsts[:1]][len(firsts) == 1] or [0.0]), inf], inputCol="place", outputCol="part")
    parted = cut.transform(keyed).withColumn("part", F.col("part").cast("int"))
    heads = sorted((r.part, r.head) for r in parted.groupBy("part").agg(F.max("key").alias("head")).collect())
    guests = spark.createDataFrame([(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)], "key long, host int")
    dealt = parted.join(F.broadcast(guests), "key", "left").select("key", "doc_id", "text", F.explode(F.array_compact(F.array(
        F.struct(F.col("part"), F.lit(False).alias("guest")),
        F.when(F.col("host").isNotNull(), F.struct(F.col("host").alias("part"), F.lit(True).alias("guest")))))).alias("to"))
    return (dealt.select("to.part", "to.guest", "key", "doc_id", "text").repartitionById(len(firsts) + 1, F.col("part"))
            .sortWithinPartitions("part", "guest", F.desc("key"), "text").select("part", "guest", "doc_id", "text"))


def edited_fingerprints(docs: DataFrame, k: int = K, window: int = WINDOW, ranges: int | None = None) -> DataFrame:
    """Fingerprints of each text and of the text with its last half replaced by the next text's beginning.

    The last ``floor(n_chars / 2)`` code points go, and as many of the next text (or all) come.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[
                "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

        pending = None
        for batch in batches:
            out: list[tuple] = []
            held = 0
            rows = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            for part, guest, doc_id, text in rows:
                if guest and (pending is None or pending[0] != part):
                    continue
                text = text or ""
                marks = winnow(code_points(text), k, window)
                if pending is not None:
                    _, before_id, before, own = pending
                    half = len(before) // 2
                    edited = before[:len(before) - half] + text[:half]
                    changed = winnow(code_points(edited), k, window)
                    out.append((before_id, len(before), hashlib.sha256(edited.encode()).hexdigest(), write(*own),
                                write(*changed), likeness(own[0], changed[0]), likeness(own[0], marks[0])))
                    held += len(before)
                    if held >= SENT:
                        yield made(out)
                        out, held = [], 0
                pending = None if guest else (part, doc_id, text, marks)
            if out:
                yield made(out)

    return neighbours(docs, ranges).mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
             "near_edited double, near_next double")
