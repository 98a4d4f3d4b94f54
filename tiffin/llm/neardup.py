"""Near-duplicate documents: fast similarity sketching, banding, exact verification.

Shingles are five consecutive lower-cased words (A-Z), each as a 64-bit hash.  The
sketch has ``t`` coordinates.  In round i every shingle is hashed anew and thrown
into a coordinate; a coordinate keeps the smallest value of the first round that
reached it.  Rounds 0..t-1 choose the coordinate by hash, rounds t..2t-1 are aimed
at coordinates 0..t-1, so every coordinate is filled after 2t rounds at the latest,
and usually after two or three.  Two sketches agree in a coordinate with probability
J, the similarity of the sets, with the concentration of independent samples.

1. Equal sets form one class; only its smallest document goes on, so copies cost nothing.
2. Bands of ``rows`` coordinates are bucket keys.  With 32 bands of 4 rows a pair at
   J = 0.75 misses every bucket with probability 5e-6.
3. Buckets compare one bit per coordinate, in blocks.  Pairs with as many equal bits as
   J = 0.75 gives, less six standard deviations, are held together by a spanning forest,
   so what leaves a bucket grows with its members and not with its pairs.
4. The forests' components are families.  Each class travels once to its family with its
   full set; there every pair of different components with similar sketches is verified
   on full sets until it is linked or refuted, and only links that join components leave.
   Large families are cut into blocks and every two blocks meet.  So every pair that
   shares a bucket is in one component already, or verified, or too far apart; no bucket
   or family is capped.

Rows: texts without words have an empty set, ``n_shingles`` 0, and are linked with
nothing.  Fewer than five words make one shingle of all of them.  Rows without
``doc_id`` have component null, link nothing and are kept.  Repeated rows of one
``doc_id`` share its component.  Different texts under one ``doc_id`` are one node with
the links of both; each row carries the component of its own text's class.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.llm import words as W
from tiffin.llm.components import components

Stage = Callable[[DataFrame], DataFrame]

#: Rows that a task compares with one another at a time; larger groups are cut into blocks.
BLOCK_ROWS = 4096
#: Shingles of a block of a family.
BLOCK_SHINGLES = 1 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    found = W.split(data, offsets, lower=True)
    hashes = found.hashes()
    rolled = W.rolling(hashes, size)
    for begin, end in zip(found.first[:-1], found.first[1:], strict=True):
        if end - begin >= size:
            yield np.unique(rolled[begin:end - size + 1])
        elif end > begin:
            yield W.stretches(hashes[begin:end], np.array([0]), np.array([end - begin]), W.BASES[0])
        else:
            yield np.zeros(0, dtype=np.uint64)


def sketch(shingles: np.ndarray, t: int) -> np.ndarray:
    """The fast similarity sketch of a non-empty set; ``t`` is a power of two."""
    out = np.empty(t, dtype=np.uint64)
    empty = np.ones(t, dtype=bool)
    bits = np.uint64(t.bit_length() - 1)
    for i in range(2 * t):
        value = W.mix(shingles ^ np.uint64((i + 1) * W.BASES[0] & (2**64 - 1)))
        turn = np.array([i * W.BASES[1] & (2**64 - 1)], dtype=np.uint64)
        if i < t:
            least = np.full(t, np.uint64(2**64 - 1))
            np.minimum.at(least, (value & np.uint64(t - 1)).astype(np.intp), value >> bits)
            fill = empty & (least != np.uint64(2**64 - 1))
            out[fill] = least[fill] + turn
            empty &= ~fill
        elif empty[i - t]:
            out[i - t] = ((value >> bits).min() + turn)[0]
            empty[i - t] = False
        if not empty.any():
            break
    return out


def sketches(docs: DataFrame, shingle: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): a hash of the text, set size, a 128-bit key of the set, band keys, one byte and one bit per coordinate."""
    t = bands * rows
    if t & (t - 1):
        raise ValueError("bands * rows must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.chunks(batches):
            sizes, keys, made = [], [], []
            for shingles in shingle_sets(data, offsets, shingle):
                sizes.append(len(shingles))
                keys.append(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest())
                made.append(sketch(shingles, t) if len(shingles) else None)
            full = np.array([m is not None for m in made])
            flat = np.array([m for m in made if m is not None], dtype=np.uint64).reshape(-1, bands, rows)
            banded = np.zeros(flat.shape[:2], dtype=np.uint64)
            for j in range(rows):
                banded = W.mix(banded * np.uint64(W.BASES[0]) + flat[:, :, j])
            banded = W.mix(banded + np.arange(bands, dtype=np.uint64) * np.uint64(W.BASES[1]))
            low = (W.mix(flat.reshape(-1, t)) & np.uint64(255)).astype(np.uint8)
            single = iter(np.packbits(low & 1, axis=1))
            low = iter(low)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
                W.lists(W.signed(banded.ravel()), np.where(full, bands, 0), pa.int64()),
                pa.array([next(low).tobytes() if f else b"" for f in full], pa.binary()),
                pa.array([next(single).tobytes() if f else b"" for f in full], pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "set_key", "bands", "sketch", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_key")).mapInArrow(
        W.lean(run), "doc_id long, text_key long, n_shingles long, set_key binary, bands array<long>, sketch binary, bits binary")


def full_sets(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """The shingle hashes of every row of ``docs`` (doc_id, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.chunks(batches):
            sets = list(shingle_sets(data, offsets, shingle))
            counts = np.array([len(s) for s in sets])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), W.lists(W.signed(np.concatenate(sets)), counts, pa.int64())],
                names=["doc_id", "shingles"])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        W.lean(run), "doc_id long, shingles array<long>")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole groups of rows that arrive sorted by their first column."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        keys = batch.column(0).to_pylist()
        begin = 0
        for i, key in enumerate(keys):
            if key != current:
                if i > begin:
                    held.append(batch.slice(begin, i - begin))
                if held:
                    yield pa.Table.from_batches(held)
                held, begin, current = [], i, key
        held.append(batch.slice(begin))
    if held and sum(h.num_rows for h in held):
        yield pa.Table.from_batches(held)


class _Union:
    """Components of the rows of a group, by their labels."""

    def __init__(self, labels: np.ndarray):
        _, self.label = np.unique(labels, return_inverse=True)

    def join(self, i: int, j: int) -> None:
        self.label[self.label == self.label[j]] = self.label[i]


def _candidates(part: pa.Table, percent: int, least_equal: int, single: bool = False) -> Iterator[tuple[int, np.ndarray, _Union]]:
    """Rows with the rows of other components that may be linked to them, nearest first.

    Rows begin as components of their own.  Of every pair one row comes first, so one pass over the rows suffices.
    Where a group is a pair of blocks (``side`` 0 or more) only pairs across the blocks count.  Sketches hold a
    byte per coordinate, or a ``single`` bit."""
    side, size = part.column("side").to_numpy(), part.column("n_shingles").to_numpy()
    marks = np.frombuffer(b"".join(part.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(side), -1)
    words = marks.view(np.uint64) if single else None
    state = _Union(part.column("node").to_numpy())
    done = np.zeros(len(side), dtype=bool)
    for i in range(len(side) - 1):
        done[i] = True
        ok = ~done & (state.label != state.label[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
        if side[i] >= 0:
            ok &= side != side[i]
        rest = np.flatnonzero(ok)
        equal = 8 * marks.shape[1] - np.bitwise_count(words[rest] ^ words[i]).sum(axis=1, dtype=np.int64) if single else (
            marks[rest] == marks[i]).sum(axis=1)
        order = np.argsort(-equal, kind="stable")
        rest = rest[order][equal[order] >= least_equal]
        if len(rest):
            yield i, rest, state


def _edges(pairs: list[tuple[int, int]], node: np.ndarray) -> pa.RecordBatch:
    a, b = node[[i for i, _ in pairs]], node[[j for _, j in pairs]]
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])


def _forest(batches: Iterator[pa.RecordBatch], least_equal: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Join what may be linked within each group."""
    for part in _groups(batches):
        if part.num_rows < 2:
            continue
        pairs = []
        for i, rest, state in _candidates(part, percent, least_equal, single=True):
            for j in rest.tolist():
                if state.label[j] != state.label[i]:
                    state.join(i, j)
                    pairs.append((i, j))
        if pairs:
            yield _edges(pairs, part.column("node").to_numpy())


def _links(batches: Iterator[pa.RecordBatch], least_equal: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Verify on full sets whatever may join two components of a group."""
    for part in _groups(batches):
        sets = part.column("shingles").combine_chunks()
        flat = np.asarray(sets.flatten()).view(np.uint64)
        ends = np.append(0, np.cumsum(np.asarray(sets.value_lengths())))
        pairs = []
        for i, rest, state in _candidates(part, percent, least_equal):
            own = flat[ends[i]:ends[i + 1]]
            for begin in range(0, len(rest), 64):
                some = rest[begin:begin + 64]
                some = some[state.label[some] != state.label[i]]
                if not len(some):
                    continue
                lengths = ends[some + 1] - ends[some]
                other = np.concatenate([flat[ends[j]:ends[j + 1]] for j in some])
                met = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                both = np.add.reduceat(met, np.cumsum(lengths) - lengths, dtype=np.int64)
                for j in some[100 * both >= percent * (len(own) + lengths - both)].tolist():
                    if state.label[j] != state.label[i]:
                        state.join(i, j)
                        pairs.append((i, j))
        if pairs:
            yield _edges(pairs, part.column("node").to_numpy())


def _blocks(rows: DataFrame, blocks: Column, key: str) -> DataFrame:
    """Give rows to every pair of the blocks of their group: ``group`` and ``side`` (-1 inside one block)."""
    blocked = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    paired = blocked.withColumn("partner", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return (paired.withColumn("group", F.concat_ws("/", key, F.least("block", "partner"), F.greatest("block", "partner")))
            .withColumn("side", F.when(F.col("block") == F.col("partner"), -1).otherwise(F.col("block")))
            .drop("blocks", "block", "partner"))


def near_duplicates(docs: DataFrame, stage: Stage, shingle: int = 5, percent: int = 75, bands: int = 32,
                    rows: int = 4, block_rows: int = BLOCK_ROWS, block_shingles: int = BLOCK_SHINGLES,
                    text_key: str | None = None) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` (smallest doc_id reachable over links) and ``kept``, per row.

    ``text_key`` names one more column, the ``xxhash64`` of the row's text, which tells rows of one id apart.

    Links are pairs with 100 * intersection >= percent * union, confirmed on full sets.
    """
    rows_of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    every = stage(sketches(rows_of, shingle, bands, rows))
    named = every.filter("doc_id IS NOT NULL AND n_shingles > 0")
    classes = stage(named.groupBy("set_key").agg(F.min("doc_id").alias("node")))
    nodes = stage(named.join(classes, "set_key").filter("doc_id = node")
                  .select("set_key", "node", "n_shingles", "bands", "sketch", "bits").dropDuplicates(["set_key"]))

    spots = nodes.select("node", "n_shingles", F.col("bits").alias("sketch"), F.explode("bands").alias("bucket"))
    buckets = stage(spots.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"))
    t, share = bands * rows, (1 + percent / 100) / 2
    least_bits = int(t * (share - 6 * (share * (1 - share) / t) ** 0.5))
    grouped = _blocks(spots.join(buckets.hint("merge"), "bucket"), F.when(F.col("n") <= block_rows, 1).otherwise(
        F.ceil(2 * F.col("n") / F.lit(block_rows))).cast("int"), "bucket")
    forest = stage(grouped.select("group", "side", "node", "n_shingles", "sketch")
                   .repartition("group").sortWithinPartitions("group")
                   .mapInArrow(W.lean(lambda it: _forest(it, least_bits, percent)), "a long, b long"))
    family = components(forest, stage)
    family = stage(family.unionByName(family.select(F.col("component").alias("node"), "component").distinct())
                   .toDF("node", "family"))

    texts = rows_of.filter("doc_id IS NOT NULL").withColumn("text_key", F.xxhash64("text"))
    least_equal = int(t * (percent / 100 - 6 * (percent * (100 - percent) / 1e4 / t) ** 0.5))
    members = (full_sets(texts.join(family.hint("merge"), F.col("doc_id") == F.col("node"), "left_semi")
                         .dropDuplicates(["doc_id", "text_key"]), shingle).withColumnRenamed("doc_id", "node")
               .join(family, "node").join(nodes.select("node", "sketch"), "node")
               .select("family", "node", F.size("shingles").cast("long").alias("n_shingles"), "sketch", "shingles"))
    members = stage(members)
    sizes = stage(members.groupBy("family").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("total")))
    met = _blocks(members.join(sizes, "family"), F.when(
        (F.col("n") <= block_rows) & (F.col("total") <= 2 * block_shingles), 1).otherwise(F.ceil(F.greatest(
            2 * F.col("n") / F.lit(block_rows), F.col("total") / F.lit(block_shingles)))).cast("int"), "family")
    links = stage(met.select("group", "side", "node", "n_shingles", "sketch", "shingles")
                  .repartition("group").sortWithinPartitions("group")
                  .mapInArrow(W.lean(lambda it: _links(it, least_equal, percent)), "a long, b long"))
    final = components(links, stage)

    joined = classes.join(final, "node", "left").select("set_key", F.coalesce("component", "node").alias("component_id"))
    joined = stage(joined)
    more = [F.col("text_key").alias(text_key)] if text_key else []
    return (every.select("doc_id", "text_key", "n_shingles", "set_key").join(joined, "set_key", "left").select(
        "doc_id", *more, "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))
