"""Document quality by Bradley-Terry ranking of preference pairs.

Each document has a score w.x of its features; that document a is preferred to b has
probability 1 / (1 + exp(w.x_b - w.x_a)).  Pairs join a good and a bad labelled document,
so w is fitted by logistic loss on feature differences, without an intercept.  The
threshold is a quantile of the scores of the labelled sample: ``strictness`` (0.99) times
the share that is labelled bad, so that in doubt a document is kept.

Features are about form, not about particular words, and come from the whole text: how
often each class of bytes follows each other class (letters by case, digits, white
space, line ends, each punctuation mark), in hashed bins; lengths of words and lines;
how varied the words are and how often a word follows itself.  The text alone is used.

Every labelled row teaches.  Rows are dealt by a hash of their id to groups of about
``GROUP_ROWS`` of the more frequent label; pairs are made inside a group, and a rare label's
rows are copied to as many groups as it takes for each to hold ``LEAST_OTHER`` of them.
Groups are staged once; tasks sum slope and bend of the likelihood over them, and only
these sums reach the driver.  The threshold is exact, by counts in ever smaller ranges of
scores.  Every document is scored.  Rows: null and empty texts have features of an empty text.  Labels other
than 0 and 1, and labels without a document, teach nothing; an id that repeats teaches once,
by its least features.  Without both labels all
scores are 1.  Repeated rows are scored alike.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.llm import words as W
from tiffin.session import Stage

PAIRS = 2
#: Rows of the more frequent label in a group, and rows of the other it holds at least, if there are as many.
GROUP_ROWS = 2048
LEAST_OTHER = 256
#: Ranges of scores that are counted at a time, and different scores that are looked at one by one.
RANGES = 1000
FEW_SCORES = 10_000
BINS = 96
SHAPE = 12


def _classes() -> np.ndarray:
    """A class for each byte value: marks one by one, letters, digits and the rest by kind."""
    kind = np.zeros(256, dtype=np.int64)
    kind[ord("a"):ord("z") + 1] = 1
    kind[ord("A"):ord("Z") + 1] = 2
    kind[ord("0"):ord("9") + 1] = 3
    kind[128:] = 4
    kind[[0x20, 0x09]] = 5
    kind[0x0A:0x0E] = 6
    marks = [b for b in range(0x21, 0x7F) if not chr(b).isalnum()]
    kind[marks] = np.arange(7, 7 + len(marks))
    return kind


_KIND = _classes()
_PAIR_BIN = (W.mix(np.arange(64 * 64, dtype=np.uint64) * np.uint64(W.BASES[0])) % np.uint64(BINS)).astype(np.int64)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``BINS + SHAPE`` features per document."""
    offsets = offsets - offsets[0]
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    some = np.maximum(size, 1)
    kind = _KIND[data]
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = np.zeros((n, BINS + SHAPE))
    if len(data) > 1:
        inside = owner[1:] == owner[:-1]
        bins = _PAIR_BIN[kind[:-1] * 64 + kind[1:]] + owner[:-1] * BINS
        counts = np.bincount(bins[inside], minlength=n * BINS).reshape(n, BINS)
        out[:, :BINS] = np.sqrt(counts / some[:, None])

    found = W.split(data, offsets)
    total = np.diff(found.first).astype(np.float64)
    several = np.maximum(total, 1)
    hashes = found.hashes()
    word_owner = found.document()
    lengths = (found.ends - found.starts).astype(np.float64)

    def by_doc(values: np.ndarray) -> np.ndarray:
        return np.bincount(word_owner[:len(values)], weights=values, minlength=n)

    again = np.zeros(len(hashes))
    if len(hashes) > 1:
        again[:-1] = (hashes[1:] == hashes[:-1]) & (word_owner[1:] == word_owner[:-1])
    pairs = np.lexsort((hashes, word_owner)) if len(hashes) else np.zeros(0, dtype=np.int64)
    new = np.ones(len(pairs))
    if len(pairs) > 1:
        new[1:] = (hashes[pairs][1:] != hashes[pairs][:-1]) | (word_owner[pairs][1:] != word_owner[pairs][:-1])
    distinct = np.bincount(word_owner[pairs], weights=new, minlength=n) if len(pairs) else np.zeros(n)

    def share(low: int, high: int) -> np.ndarray:
        return np.bincount(owner, weights=(kind >= low) & (kind <= high), minlength=n) / some

    lines = np.bincount(owner, weights=kind == 6, minlength=n) + 1
    mean = by_doc(lengths) / several
    shape = [np.log1p(size) / 10, np.log1p(total) / 10, mean / 10,
             np.sqrt(np.maximum(by_doc(lengths ** 2) / several - mean ** 2, 0)) / 10,
             distinct / several, 4 * by_doc(again) / several, np.log1p(total / lines) / 5,
             np.log1p(total / np.maximum(distinct, 1)), 2 * share(2, 2), 2 * share(3, 3), 4 * share(7, 63), size == 0]
    out[:, BINS:] = np.column_stack(shape)
    return out


@dataclass
class Ranker:
    """Weights of the Bradley-Terry scores, the quantile threshold and the slope of the scores."""

    weights: list[float]
    threshold: float
    slope: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; 0.3 at the threshold, and by the odds of the preference model around it."""
        if not self.weights:
            return np.ones(len(rows))
        # summed row by row, so that equal texts score alike in whatever batch
        odds = ((rows * np.array(self.weights)).sum(axis=1) - self.threshold) * self.slope + math.log(0.3 / 0.7)
        return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def featured(docs: DataFrame, keep: str, kind: str) -> DataFrame:
    """Column ``keep`` of each row with its ``features``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.chunks(batches):
            rows = features(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), W.lists(rows.ravel(), np.full(len(rows), rows.shape[1]), pa.float64())],
                names=[keep, "features"])
    return docs.select(keep, "text").mapInArrow(W.lean(run), f"`{keep}` {kind}, features array<double>")


def sampled(docs: DataFrame, labels: DataFrame, most: dict[int, int], seed: int = 7) -> DataFrame:
    """``doc_id, text, label`` of at most ``most[label]`` labelled documents of each label, chosen by a hash of their id.

    Ids are chosen among ``labels`` (doc_id, label) alone, so their number is bounded before they are
    broadcast and documents are read once.  An id that repeats gives one row, its least text; rows of one
    id are reduced before they are exchanged.
    """
    place = F.xxhash64(F.lit(seed), F.col("doc_id"))
    known = labels.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "label")
    chosen = None
    for label, limit in most.items():
        some = known.filter(F.col("label") == label).distinct().orderBy(place, "doc_id").limit(limit)
        chosen = some if chosen is None else chosen.unionByName(some)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def fit_preferences(differences: np.ndarray, decay: float = 1e-4, rounds: int = 25) -> np.ndarray:
    """Weights under which ``1 / (1 + exp(-w.x))`` best explains that every difference (preferred less other)
    was preferred, with a small penalty on their square; Newton steps."""
    return _climb(len(differences), differences.shape[1], lambda weights: _sums(differences, weights),
                  lambda step: np.abs(differences @ step).max(), decay, rounds)


def _sums(differences: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Slope and bend of the likelihood, summed over the differences, and the largest size of each feature, as rows."""
    chance = 1 / (1 + np.exp(-np.clip(differences @ weights, -30, 30)))
    return np.vstack([differences.T @ (1 - chance), np.abs(differences).max(axis=0),
                      (differences * (chance * (1 - chance))[:, None]).T @ differences])


def _added(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    total = one + other
    total[1] = np.maximum(one[1], other[1])
    return total


def _climb(count: int, size: int, sums: Callable[[np.ndarray], np.ndarray], reach: Callable[[np.ndarray], float],
           decay: float = 1e-4, rounds: int = 25) -> np.ndarray:
    """Newton steps; one that moves some difference by more than 5 (``reach``) is shortened."""
    weights = np.zeros(size)
    for _ in range(rounds):
        found = sums(weights)
        slope = found[0] / count - decay * weights
        step = np.linalg.solve(found[2:] / count + decay * np.eye(size), slope)
        farthest = reach(step) if found[1] @ np.abs(step) > 5 else 0.0
        weights += step * min(1.0, 5 / max(farthest, 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return weights


def _pairs(bad: np.ndarray, good: np.ndarray, pairs: int, seed: int) -> np.ndarray:
    """Differences of a group: each row of the more frequent label meets ``pairs`` rows of the other."""
    rng = np.random.default_rng(seed)
    count = pairs * max(len(bad), len(good))
    return good[np.resize(rng.permutation(len(good)), count)] - bad[
        np.concatenate([rng.permutation(len(bad)) for _ in range(-(-count // len(bad)))])[:count]]


def _dealt(docs: DataFrame, known: DataFrame, counts: dict[int, int], seed: int) -> DataFrame:
    """``place, number, bad, good`` per group: the features of its rows of each label, as bytes."""
    groups = -(-max(counts.values()) // GROUP_ROWS)
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(groups))
    copies = {label: min(groups, -(-groups * LEAST_OTHER // n)) for label, n in counts.items()}
    taught = (featured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL"), "doc_id", "long")
              .select("doc_id", F.col("features").cast("array<float>").alias("features"))
              .join(known, "doc_id").groupBy("doc_id", "label").agg(F.min("features").alias("features")))
    further = F.when(F.col("label") == 0, copies[0]).otherwise(copies[1])
    laid = (taught.withColumn("_turn", F.explode(F.sequence(F.lit(0), further - 1)))
            .select(F.pmod(place + F.col("_turn"), F.lit(groups)).alias("place"), "doc_id", "label", "features")
            .repartition("place").sortWithinPartitions("place", "label", "doc_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}

        def done(place: int) -> pa.RecordBatch:
            made = [[place], [b"".join(held.pop(0, []))], [b"".join(held.pop(1, []))]]
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(made, (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["place", "bad", "good"])

        now = None
        for batch in batches:
            places, labels = (np.asarray(batch.column(n)) for n in ("place", "label"))
            values = np.asarray(batch.column("features").flatten()).astype(np.float32).reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((np.diff(places) != 0) | (np.diff(labels) != 0)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if begin == end:
                    continue
                if now is not None and places[begin] != now:
                    yield done(now)
                now = int(places[begin])
                held.setdefault(int(labels[begin]), []).append(values[begin:end].tobytes())
        if now is not None:
            yield done(now)

    return laid.select("place", "label", "features").mapInArrow(W.lean(run), "place long, bad binary, good binary")


def _rows(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, dtype=np.float32).reshape(-1, BINS + SHAPE).astype(np.float64)


def _over_groups(dealt: DataFrame, measure: Callable[[np.ndarray], np.ndarray], add: Callable[[np.ndarray, np.ndarray], np.ndarray],
                 pairs: int, seed: int) -> np.ndarray | None:
    """``measure`` of the differences of every group, added up in tasks, then in at most 8 of them, then on the driver."""
    def total(found: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        if found:
            first, whole = min(f[0] for f in found), reduce(add, [m for _, m in sorted(found, key=lambda f: f[0])])
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([whole.tobytes()], pa.binary())], names=["place", "total"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, whole = None, None
        for batch in batches:
            for place, bad, good in zip(*(batch.column(i) for i in range(3)), strict=True):
                if len(bad.as_buffer()) and len(good.as_buffer()):
                    made = measure(_pairs(_rows(bad.as_buffer()), _rows(good.as_buffer()), pairs, seed + place.as_py()))
                    first, whole = (place.as_py(), made) if whole is None else (first, add(whole, made))
        yield from total([] if whole is None else [(first, whole)])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from total([(p.as_py(), np.frombuffer(t.as_buffer())) for batch in batches for p, t in zip(*batch.columns, strict=True)])

    flat = "place long, total binary"
    parts = dealt.mapInArrow(W.lean(run), flat).repartition(8, "place").mapInArrow(W.lean(join), flat).collect()
    return reduce(add, [np.frombuffer(r.total) for r in sorted(parts)]) if parts else None


def train(docs: DataFrame, labels: DataFrame, pairs: int = PAIRS, seed: int = 7, strictness: float = 0.99) -> Ranker:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, label): every labelled row meets rows of the other label."""
    known = labels.filter("doc_id IS NOT NULL AND label IN (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).distinct()
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    counts = {r.label: r["count"] for r in known.join(named, "doc_id", "left_semi").groupBy("label").count().collect()}
    if len(counts) < 2:
        return Ranker([], 0.0, 1.0)
    size = BINS + SHAPE
    with Stage(docs.sparkSession) as stage:
        dealt = stage(_dealt(docs, known, counts, seed))
        count = int(_over_groups(dealt, lambda d: np.array([float(len(d))]), np.add, pairs, seed)[0])

        def sums(weights: np.ndarray) -> np.ndarray:
            return _over_groups(dealt, lambda d: _sums(d, weights).ravel(),
                                lambda a, b: _added(a.reshape(-1, size), b.reshape(-1, size)).ravel(), pairs, seed).reshape(-1, size)

        def reach(step: np.ndarray) -> float:
            return float(_over_groups(dealt, lambda d: np.array([np.abs(d @ step).max()]), np.maximum, pairs, seed)[0])

        weights = _climb(count, size, sums, reach)
        bad_share = labels.agg(F.avg(F.when(F.col("label") == 0, 1.0).when(F.col("label") == 1, 0.0))).first()[0]
        scores = stage(_label_scores(dealt, weights, counts).groupBy("score").agg(
            F.sum("bad").alias("bad"), F.sum("good").alias("good")))
        return Ranker(weights.tolist(), _threshold(scores, bad_share, strictness), 1.0)


def _label_scores(dealt: DataFrame, weights: np.ndarray, counts: dict[int, int]) -> DataFrame:
    """``score, bad, good``: the score of every row of each group and the row's part of its label.

    A copied row comes with as many parts as it has copies."""
    groups = -(-max(counts.values()) // GROUP_ROWS)
    part = [1 / min(groups, -(-groups * LEAST_OTHER // counts[label])) for label in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                bad, good = ((_rows(batch.column(i)[place].as_buffer()) * weights).sum(axis=1) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate([bad, good])), pa.array(np.repeat([part[0], 0.0], [len(bad), len(good)])),
                    pa.array(np.repeat([0.0, part[1]], [len(bad), len(good)]))], names=["score", "bad", "good"])

    return dealt.mapInArrow(W.lean(run), "score double, bad double, good double")


def _threshold(scores: DataFrame, bad_share: float, strictness: float) -> float:
    """The quantile of ``_calibrated`` over ``scores`` (score, bad, good; each score once, with its rows of each label).

    The range that holds it is cut in ``RANGES`` until it holds ``FEW_SCORES`` at most."""
    facts = scores.agg(F.min("score").alias("low"), F.max("score").alias("high"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    weight = F.col("bad") * F.lit(bad_share / facts.bad) + F.col("good") * F.lit((1 - bad_share) / facts.good)
    low, high, below, goal = facts.low, facts.high, 0.0, strictness * bad_share - 1e-9 / (facts.bad + facts.good)
    while True:
        inside = scores.filter((F.col("score") >= low) & (F.col("score") <= high))
        width = (high - low) / RANGES
        if not width > 0 or inside.count() <= FEW_SCORES:
            break
        cut = F.least(F.floor((F.col("score") - low) / width), F.lit(RANGES - 1))
        found = inside.groupBy(cut.alias("cut")).agg(
            F.min("score").alias("low"), F.max("score").alias("high"), F.sum(weight).alias("weight")).orderBy("cut").collect()
        for r in found:
            low, high = r.low, r.high
            if below + r.weight >= goal:
                break
            below += r.weight
    for r in inside.withColumn("weight", weight).orderBy("score").collect():
        at, bad, good = r.score, r.bad, r.good
        if below + r.weight >= goal:
            break
        below += r.weight
    # of equal scores the bad ones come first; is the row that reaches the goal the last of them?
    last = (1 - bad_share) / facts.good if good > 0.5 else bad_share / facts.bad
    inner = below + bad * bad_share / facts.bad + good * (1 - bad_share) / facts.good - last
    above = None if inner >= goal else scores.filter(F.col("score") > at).agg(F.min("score")).first()[0]
    return float(at if above is None else (at + above) / 2)


def _calibrated(weights: np.ndarray, bad: np.ndarray, good: np.ndarray, bad_share: float, strictness: float = 1.0) -> Ranker:
    """The threshold is a quantile of all labelled scores, each label weighed by its share."""
    scores = np.concatenate([bad, good])
    weight = np.concatenate([np.full(len(bad), bad_share / len(bad)), np.full(len(good), (1 - bad_share) / len(good))])
    order = np.argsort(scores, kind="stable")
    at = int(np.searchsorted(np.cumsum(weight[order]), strictness * bad_share, side="left"))
    at = min(at, len(order) - 1)
    above = min(at + 1, len(order) - 1)
    return Ranker(weights.tolist(), float(scores[order][at] + scores[order][above]) / 2, 1.0)


def score(docs: DataFrame, ranker: Ranker, columns: list[str] | None = None, into: str = "score") -> DataFrame:
    """``columns`` of every row of ``docs`` (default: all) with its score, which replaces a column ``into``."""
    names = [c for c in (columns or docs.columns) if c != into]
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.chunks(batches, "_rank_text"):
            kept = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(ranker.score(features(data, offsets)))], names=[*names, into])

    fields = ", ".join(f"`{c}` {types[c]}" for c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("_rank_text")).mapInArrow(W.lean(run), f"{fields}{', ' if fields else ''}`{into}` double")


def held_out(doc_id: Column) -> Column:
    """Rows that never teach: crc32 of the id as text leaves 0 modulo 5; a row without id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))
