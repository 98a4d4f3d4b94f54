"""Toxic spans by a linear-chain conditional random field.

A token is a run of letters.  Each is clean or toxic; its features are the word, its
first four and five bytes, its last three, and the words before and after.  The score
of a labelling adds the weights of the features of toxic tokens and of the label pairs.
Forward-backward gives each token's marginal probability; a document's score is its
largest, and tokens at 0.5 or more are its spans.

Training tokens take their labels from labelled documents: in a toxic document a token
counts as toxic if its word or one of its beginnings occurs in so many toxic documents,
and in (nearly) no clean ones, that less than one such feature would be expected by
chance among all of them.  Counts and weights are fitted on the same documents, at most
``sample`` toxic and four times as many clean ones, the first in order of a hash of
their id, and ``most_bytes`` of text: documented bounds, whatever the size of the tables.
Texts become feature numbers in tasks and do not reach the driver.  Every document is
tagged over its whole text.

The chain of a whole chunk of documents is one chain that starts anew at each document.
Steps of the ratio toxic/clean are fractional-linear maps, so the chain is cut into rows
that are composed side by side and joined in sequence: exact, in numpy operations over
many rows at a time.

Rows: null and empty texts score 0 and have no spans.  Without toxic or clean training
documents every score is 0.  Repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm import words as W
from tiffin.llm.quality_ranker import sampled

SAMPLE = 1000
#: Bytes of the texts that teach; their tokens reach the driver as six numbers of four bytes each.
MOST_BYTES = 24_000_000
#: Bits of the hashed number of each kind of feature: word, two beginnings, ending, word before, word after.
BITS = (22, 18, 18, 18, 18, 18)
KINDS = len(BITS)
_BASE = np.append(0, np.cumsum([1 << b for b in BITS]))
FEATURES = int(_BASE[-1])
_ROW = 256


def token_features(data: np.ndarray, offsets: np.ndarray) -> tuple[W.Words, np.ndarray]:
    """Tokens and, per token, six feature numbers; each kind has its own range of numbers."""
    found = W.split(data, offsets, lower=True, word_bytes=W.LETTERS)
    n = len(found.starts)
    up, down = W.powers(W.BASES[0], len(found.data) + 1)
    total = np.zeros(len(found.data) + 1, dtype=np.uint64)
    np.cumsum((found.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])

    def part(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return W.mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))

    own = part(found.starts, found.ends)
    first = np.zeros(n, dtype=bool)
    first[found.first[:-1][np.diff(found.first) > 0]] = True
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = np.where(first[1:], 0, own[:-1])
    after[:-1] = np.where(first[1:], 0, own[1:])
    kinds = [own, part(found.starts, np.minimum(found.starts + 4, found.ends)),
             part(found.starts, np.minimum(found.starts + 5, found.ends)),
             part(np.maximum(found.ends - 3, found.starts), found.ends), before, after]
    out = np.empty((KINDS, n), dtype=np.int32)
    for i, kind in enumerate(kinds):
        out[i] = (kind >> np.uint64(64 - BITS[i])).astype(np.int32) + _BASE[i]
    return found, out


def _scan(m: list[np.ndarray], start: float) -> np.ndarray:
    """Apply the maps r -> (m0 r + m1) / (m2 r + m3) one after another; the value after each."""
    n = len(m[0])
    rows = -(-n // _ROW)
    pad = rows * _ROW - n
    grid = [np.append(x, np.full(pad, fill)).reshape(rows, _ROW).T.copy() for x, fill in zip(m, (1.0, 0.0, 0.0, 1.0), strict=True)]
    a, b, c, d = (x[0].copy() for x in grid)
    for p, q, u, v in zip(*(x[1:] for x in grid), strict=True):
        a, b, c, d = p * a + q * c, p * b + q * d, u * a + v * c, u * b + v * d
        scale = 1 / np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a * scale, b * scale, c * scale, d * scale
    begin = np.empty(rows)
    value = start
    for i, (p, q, u, v) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist(), strict=True)):
        begin[i] = value
        value = (p * value + q) / (u * value + v)
    out = np.empty((_ROW, rows))
    value = begin
    for i, (p, q, u, v) in enumerate(zip(*grid, strict=True)):
        value = (p * value + q) / (u * value + v)
        out[i] = value
    return out.T.ravel()[:n]


def ratios(emission: np.ndarray, first: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: exp(emission), the forward and the backward ratio toxic/clean.

    ``first`` marks the first token of each document; ``transition[i, j]`` scores label j after i."""
    x = np.exp(np.clip(emission, -30, 30))
    (a00, a01), (a10, a11) = np.exp(transition)
    keep = (~first).astype(np.float64)
    forward = _scan([x * a11 * keep, x * np.where(first, 1.0, a01), a10 * keep, np.where(first, 1.0, a00)], 1.0)
    # backward[t - 1] follows from token t; the last token's is 1
    back = [x * a11 * keep, np.where(first, 1.0, a10), x * a01 * keep, np.where(first, 1.0, a00)]
    backward = np.ones_like(x)
    if len(x) > 1:
        backward[:-1] = _scan([m[:0:-1] for m in back], 1.0)[::-1]
    return x, forward, backward


@dataclass
class Tagger:
    """Weights of the features that have one, a bias for toxic tokens, and the transitions."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    transition: np.ndarray

    def table(self) -> np.ndarray:
        """The weight of every feature number."""
        out = np.zeros(FEATURES, dtype=np.float32)
        out[self.features] = self.weights
        return out

    def marginals(self, table: np.ndarray, tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Probability that each token is toxic, given its document."""
        if tokens.shape[1] == 0:
            return np.zeros(0)
        _, forward, backward = ratios(table[tokens].sum(axis=0, dtype=np.float64) + self.bias, first, self.transition)
        both = np.minimum(forward * backward, 1e30)
        return both / (1 + both)


def untaught() -> Tagger:
    """Scores every document 0, nearly."""
    return Tagger(np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.float32), -30.0, np.zeros((2, 2)))


def _firsts(found: W.Words) -> np.ndarray:
    first = np.zeros(len(found.starts), dtype=bool)
    first[found.first[:-1][np.diff(found.first) > 0]] = True
    return first


def _smallest_run(hashes: np.ndarray, first: np.ndarray, full: np.ndarray, width: int = 4) -> np.ndarray:
    """The smallest hash of ``width`` words in a row of each non-empty document, of all its words if it has fewer."""
    none = np.iinfo(np.uint64).max
    runs = np.full(len(hashes), none)
    rolled = W.rolling(hashes, width)
    runs[:len(rolled)] = rolled
    for back in range(1, width):
        runs[np.maximum(first[full + 1] - back, first[full])] = none
    least = np.minimum.reduceat(runs, first[full])
    return np.where(least == none, W.stretches(hashes, first[full], first[full + 1], W.BASES[0]), least)


@dataclass
class Taught:
    """A document of the sample: its label, its family and the feature numbers of its tokens (kinds in rows)."""

    toxic: bool
    family: int
    tokens: np.ndarray


def numbered(rows: DataFrame) -> DataFrame:
    """``doc_id, label, family, tokens`` of ``rows`` (doc_id, text, label): feature numbers as bytes, kind by kind.

    The family is the smallest hash of four words in a row, which copies share; documents without words are left out."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.chunks(batches):
            found, tokens = token_features(data, offsets)
            full = np.flatnonzero(np.diff(found.first))
            if not len(full):
                continue
            family = _smallest_run(found.hashes(), found.first, full)
            cut = [tokens[:, found.first[i]:found.first[i + 1]].tobytes() for i in full.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(full)), batch.column(2).take(pa.array(full)), pa.array(W.signed(family)), pa.array(cut, pa.binary())],
                names=["doc_id", "label", "family", "tokens"])

    return rows.select("doc_id", "text", "label").mapInArrow(W.lean(run), "doc_id long, label int, family long, tokens binary")


def telling_features(taught: list[Taught]) -> np.ndarray:
    """Numbers of words and beginnings that mark toxic documents more often than chance allows.

    Documents of one family are taken for copies of one another and count once.
    """
    counts, families = [], []
    for toxic in (True, False):
        own: dict[int, list[np.ndarray]] = {}
        for doc in taught:
            if doc.toxic == toxic:
                own.setdefault(doc.family, []).append(doc.tokens[:3].ravel())
        count = np.zeros(FEATURES, dtype=np.int32)
        for parts in own.values():
            count[np.unique(np.concatenate(parts))] += 1
        counts.append(count)
        families.append(len(own))
    share = max(families[0], 1) / max(sum(families), 2)
    tried = int((counts[0] >= 2).sum())
    least = max(3, int(np.ceil(np.log(max(tried, 2)) / -np.log(share))))
    return np.flatnonzero((counts[0] >= least) & (counts[1] <= 0.02 * counts[0]))


#: Tokens whose forward and backward values are held at a time.
FIT_TOKENS = 200_000


def _portions(taught: list[Taught]) -> Iterator[list[Taught]]:
    """The documents in order, about ``FIT_TOKENS`` tokens at a time."""
    part, size = [], 0
    for doc in taught:
        part.append(doc)
        size += doc.tokens.shape[1]
        if size >= FIT_TOKENS:
            yield part
            part, size = [], 0
    if part:
        yield part


def fit(taught: list[Taught], rounds: int = 40, decay: float = 0.1) -> Tagger:
    """Maximise the likelihood of the token labels by scaled gradient steps, summed over portions of the documents."""
    marks = np.zeros(FEATURES, dtype=bool)
    marks[telling_features(taught)] = True
    seen = np.zeros(FEATURES, dtype=bool)
    for doc in taught:
        seen[doc.tokens] = True
    used = np.flatnonzero(seen)
    place = np.zeros(FEATURES, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    parts, pair = [], np.zeros((2, 2))
    for some in _portions(taught):
        tokens = np.concatenate([doc.tokens for doc in some], axis=1)
        first = np.zeros(tokens.shape[1], dtype=bool)
        first[np.cumsum([0, *(doc.tokens.shape[1] for doc in some[:-1])])] = True
        bad = np.repeat([doc.toxic for doc in some], [doc.tokens.shape[1] for doc in some])
        truth = bad & marks[tokens[:3]].any(axis=0)
        inside = ~first[1:]
        np.add.at(pair, (truth[:-1][inside].astype(int), truth[1:][inside].astype(int)), 1)
        parts.append((place[tokens], first, truth))
    if not any(truth.any() for *_, truth in parts):
        return untaught()
    weights, sums = np.zeros(len(used)), np.full(len(used), 1e-3)
    bias, bias_sum = -3.0, 1e-3
    transition, pair_sum = np.zeros((2, 2)), np.full((2, 2), 1e-3)
    for _ in range(rounds):
        gradient, missed, expected = -decay * weights, 0.0, np.zeros((2, 2))
        a = np.exp(transition)
        for local, first, truth in parts:
            x, forward, backward = ratios(sum(weights[kind] for kind in local) + bias, first, transition)
            both = np.minimum(forward * backward, 1e30)
            miss = truth - both / (1 + both)
            for kind in local:
                gradient += np.bincount(kind, weights=miss, minlength=len(used))
            ahead, inside = x[1:] * backward[1:], ~first[1:]
            pairs = (a[0, 0], a[0, 1] * ahead, forward[:-1] * a[1, 0], forward[:-1] * a[1, 1] * ahead)
            total = sum(pairs)
            expected += np.array([(p / total)[inside].sum() for p in pairs]).reshape(2, 2)
            missed += miss.sum()
        sums += gradient ** 2
        weights += 0.7 * gradient / np.sqrt(sums)
        bias_sum += missed ** 2
        bias += 0.3 * missed / np.sqrt(bias_sum)
        pair_sum += (pair - expected) ** 2
        transition += 0.2 * (pair - expected) / np.sqrt(pair_sum)
    kept = np.abs(weights) > 1e-3
    return Tagger(used[kept].astype(np.int32), weights[kept].astype(np.float32), float(bias), transition)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 7, rounds: int = 40,
          most_bytes: int = MOST_BYTES) -> Tagger:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, label; 1: toxic).

    Of the documents ``sampled`` chooses those teach, in order of a hash of their id, whose texts have ``most_bytes``
    together; the sizes of all of them are looked at first.  Tokens become feature numbers in tasks."""
    rows = sampled(docs, labels, {1: sample, 0: 4 * sample}, seed).withColumn("turn", F.xxhash64(F.lit(seed), "doc_id"))
    last, total = None, 0
    for r in sorted(rows.select("turn", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).collect()):
        total += r["size"]
        if total > most_bytes:
            break
        last = r.turn
    if last is None:
        return untaught()
    found = numbered(rows.filter(F.col("turn") <= last)).orderBy("doc_id", "label").select("label", "family", "tokens").toArrow()
    taught = [Taught(label == 1, family, np.frombuffer(tokens, dtype=np.int32).reshape(KINDS, -1)) for label, family, tokens in zip(
        *(found.column(n).to_pylist() for n in ("label", "family", "tokens")), strict=True)]
    if len({doc.toxic for doc in taught}) < 2:
        return untaught()
    return fit(taught, rounds)


def tag(docs: DataFrame, tagger: Tagger, columns: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """``columns`` of every row of ``docs`` (default: all), its ``score`` and its ``spans``: code point
    ranges ``start, end`` of runs of tokens at or above the threshold.  They replace columns of their names."""
    names = [c for c in (columns or docs.columns) if c not in ("score", "spans")]
    types = dict(docs.dtypes)
    place = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = tagger.table()
        for batch, data, offsets in W.chunks(batches, "_tag_text"):
            found, tokens = token_features(data, offsets)
            marginal = tagger.marginals(table, tokens, _firsts(found))
            full = np.flatnonzero(np.diff(found.first))
            scores = np.zeros(batch.num_rows)
            if len(full):
                scores[full] = np.maximum.reduceat(marginal, found.first[full])
            spans: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            base = offsets - offsets[0]
            for row in np.flatnonzero(scores >= threshold).tolist():
                at = np.arange(found.first[row], found.first[row + 1])
                at = at[marginal[at] >= threshold]
                breaks = np.flatnonzero(np.append(True, np.diff(at) > 1))
                starts, ends = found.starts[at[breaks]] - base[row], found.ends[at[np.append(breaks[1:], len(at)) - 1]] - base[row]
                points = np.cumsum((data[base[row]:base[row + 1]] & 0xC0) != 0x80)
                spans[row] = [{"start": int(points[s]) - 1, "end": int(points[e - 1])} for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), pa.array(scores), pa.array(spans, pa.list_(place))],
                names=[*names, "score", "spans"])

    fields = ", ".join(f"`{c}` {types[c]}" for c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("_tag_text")).mapInArrow(
        W.lean(run), f"{fields}, score double, spans array<struct<start: long, end: long>>")
