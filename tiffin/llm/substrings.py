"""Repeated passages removed exactly, with super-k-mer partitioning.

A window is ``width`` consecutive words of one document.  A window's minimiser is
the smallest hash among its ``seed_words``-word pieces, so equal windows have equal
minimisers.  Consecutive windows with one minimiser form a super-k-mer: a single
stretch of text, sent packed to the minimiser's bucket, where its windows are
sorted and the first document of each is found.

Before any text moves, descriptions (minimiser, content key, place) tell which
minimisers occur in two documents at all and which stretches are equal.  A text
travels only for a minimiser with several different stretches in several documents,
and once per different stretch however many copies there are.  Nothing is lost by
that: a window that two documents share has the same minimiser in both.

Rows: a null or empty text has no words.  A row without ``doc_id`` is kept as it is
and marks nothing.  Repeated rows of one ``doc_id`` and text are one document; rows
of one ``doc_id`` with different texts are judged one by one, and neither is
"smaller" than the other.  All columns pass through; names starting with ``_skm_``
are used inside.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm import words as W

Stage = Callable[[DataFrame], DataFrame]

#: Windows per super-k-mer at most; a longer run of one minimiser is cut, which changes no result.
RUN_WINDOWS = 256
#: A minimiser with more different stretches than this is split by the windows themselves.
HOT_STRETCHES = 2_000
#: Bytes of packed text that a task sorts at a time.
SORT_BYTES = 4 << 20

_DESCRIPTIONS = "_skm_doc long, _skm_text long, at int, n int, minimiser long, k1 long, k2 long"


def describe(docs: DataFrame, width: int = 50, seed_words: int = 8) -> DataFrame:
    """The super-k-mers of all documents: place, number of windows, minimiser and content key."""
    if not 1 <= seed_words <= width:
        raise ValueError("seed_words must lie between 1 and width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in W.chunks(batches, "_skm_body"):
            found = W.split(data, offsets)
            hashes, others = found.hashes(W.BASES[0]), found.hashes(W.BASES[1])
            least = W.sliding_min(W.rolling(hashes, seed_words), width - seed_words + 1)
            if not len(least):
                continue
            document = found.document()
            inside = document[:len(least)] == document[width - 1:]
            begins = inside.copy()
            begins[1:] &= ~(inside[:-1] & (least[1:] == least[:-1]) & (document[1:len(least)] == document[:len(least) - 1]))
            starts = np.flatnonzero(begins)
            outside = np.append(np.flatnonzero(~inside), len(least))
            ends = np.minimum(np.append(starts[1:], len(least)), outside[np.searchsorted(outside, starts)])
            pieces = (ends - starts + RUN_WINDOWS - 1) // RUN_WINDOWS
            if len(pieces) and pieces.max() > 1:
                step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                starts, ends = np.repeat(starts, pieces) + step * RUN_WINDOWS, np.repeat(ends, pieces)
                ends = np.minimum(starts + RUN_WINDOWS, ends)
            owner = document[starts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)),
                pa.array((starts - found.first[owner]).astype(np.int32)),
                pa.array((ends - starts).astype(np.int32)),
                pa.array(W.signed(least[starts])),
                pa.array(W.signed(W.stretches(hashes, starts, ends + width - 1, W.BASES[1]))),
                pa.array(W.signed(W.stretches(others, starts, ends + width - 1, W.BASES[0]))),
            ], names=["_skm_doc", "_skm_text", "at", "n", "minimiser", "k1", "k2"])

    source = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("_skm_doc"), F.xxhash64("text").alias("_skm_text"),
        F.col("text").alias("_skm_body"))
    return source.mapInArrow(W.lean(run), _DESCRIPTIONS)


def _pack(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Cut the wanted stretches out of each text, words joined by one space."""
    for batch in batches:
        texts, wanted, docs = batch.column(0), batch.column(1), batch.column(2)
        rows: list[tuple] = []
        size = 0
        for i in range(batch.num_rows):
            body = (texts[i].as_py() or "").encode().split()
            doc = docs[i].as_py()
            for piece in wanted[i].as_py():
                packed = b" ".join(body[piece["at"]:piece["at"] + piece["n"] + width - 1])
                rows.append((piece["minimiser"], piece["k1"], piece["k2"], doc, packed))
                size += len(packed)
            if size > SORT_BYTES:
                yield _rows(rows)
                rows, size = [], 0
        if rows:
            yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.binary())],
        names=["minimiser", "k1", "k2", "doc", "packed"])


def _window_keys(packed: list[bytes], width: int) -> tuple[W.Words, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the packed stretches, the first word of each window, and two hashes of each window."""
    offsets = np.zeros(len(packed) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in packed], out=offsets[1:])
    found = W.split(np.frombuffer(b"".join(packed), dtype=np.uint8), offsets)
    counts = np.maximum(np.diff(found.first) - width + 1, 0)
    at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(found.first[:-1], counts)
    keys = [W.stretches(found.hashes(base), at, at + width, other) for base, other in (W.BASES, W.BASES[::-1])]
    return found, at, keys[0], keys[1]


def first_documents(packed: list[bytes], docs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Per window of the stretches, in order, the smallest document with an equal window; windows per stretch.

    Windows are sorted by a 128-bit key; neighbours with one key are compared word for
    word, and should two texts ever share a key all windows are compared as text instead.
    """
    found, at, high, low = _window_keys(packed, width)
    counts = np.maximum(np.diff(found.first) - width + 1, 0)
    owner = np.repeat(docs, counts)
    if not len(at):
        return owner, counts
    order = np.lexsort((low, high))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    heads = np.flatnonzero(new)
    text, begin, end = found.data.tobytes(), found.starts[at], found.ends[at + width - 1]
    group = np.cumsum(new) - 1
    for i in np.flatnonzero(~new):
        a, b = order[heads[group[i]]], order[i]
        if text[begin[a]:end[a]] != text[begin[b]:end[b]]:
            bodies = [text[s:e] for s, e in zip(begin, end, strict=True)]
            least: dict[bytes, int] = {}
            for body, doc in zip(bodies, owner, strict=True):
                least[body] = min(doc, least.get(body, doc))
            return np.array([least[b] for b in bodies], dtype=np.int64), counts
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.minimum.reduceat(owner[order], heads)[group]
    return out, counts


def _sort_buckets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Buckets arrive one after another; whole buckets are sorted together, a few megabytes at a time."""
    held: list[pa.RecordBatch] = []
    size = 0

    def solve(part: pa.Table) -> pa.RecordBatch:
        least, counts = first_documents(part.column("packed").to_pylist(), part.column("doc").to_numpy(), width)
        part = part.combine_chunks()
        return pa.RecordBatch.from_arrays(
            [part.column(k).combine_chunks() for k in ("k1", "k2", "doc")] + [W.lists(least, counts, pa.int64())],
            names=["k1", "k2", "doc", "least"])

    for batch in batches:
        begin = 0
        sizes = np.cumsum(np.diff(np.frombuffer(batch.column(4).buffers()[1], dtype=np.int32)[
            batch.column(4).offset:batch.column(4).offset + batch.num_rows + 1]))
        keys = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        for cut in cuts:
            here = size + int(sizes[cut - 1] if cut else 0) - (int(sizes[begin - 1]) if begin else 0)
            if here > SORT_BYTES and (cut or not held or held[-1].column(0)[-1].as_py() != keys[0]):
                held.append(batch.slice(begin, cut - begin))
                yield solve(pa.Table.from_batches(held))
                held, size, begin = [], 0, int(cut)
        held.append(batch.slice(begin))
        size += int(sizes[-1]) - (int(sizes[begin - 1]) if begin else 0) if batch.num_rows else 0
    if held and (left := pa.Table.from_batches(held)).num_rows:
        yield solve(left)


def _unpack_hot(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Key every window of a hot bucket's stretches, so that they spread by their own content."""
    for batch in batches:
        for begin in range(0, batch.num_rows, 2000):
            part = batch.slice(begin, 2000)
            found, _, high, low = _window_keys(part.column(4).to_pylist(), width)
            counts = np.maximum(np.diff(found.first) - width + 1, 0)
            row = pa.array(np.repeat(np.arange(part.num_rows), counts))
            at = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays(
                [part.column(k).take(row) for k in (1, 2, 3)]
                + [pa.array(at.astype(np.int32)), pa.array(W.signed(high)), pa.array(W.signed(low))],
                names=["k1", "k2", "doc", "at", "high", "low"])


def covered_windows(docs: DataFrame, stage: Stage, width: int = 50, seed_words: int = 8,
                    hot: int = HOT_STRETCHES) -> DataFrame:
    """Per document and text the stretches (``at``, ``n``, ``hits``) whose windows also start in a smaller
    document; ``hits`` lists the windows within the stretch, null for all of them."""
    spots = stage(describe(docs, width, seed_words))
    shared = stage(spots.groupBy("minimiser").agg(F.min("_skm_doc").alias("lo"), F.max("_skm_doc").alias("hi"))
                   .filter("lo < hi").select("minimiser"))
    spots = stage(spots.join(shared, "minimiser"))
    stretches = stage(spots.groupBy("minimiser", "k1", "k2").agg(
        F.min(F.struct("_skm_doc", "_skm_text", "at", "n")).alias("first"))
        .select("minimiser", "k1", "k2", "first.*"))
    sizes = stage(stretches.groupBy("minimiser").count().filter("count > 1"))
    several = stretches.join(sizes, "minimiser")

    wanted = several.groupBy("_skm_doc", "_skm_text").agg(
        F.collect_list(F.struct("at", "n", "minimiser", "k1", "k2")).alias("wanted"))
    bodies = docs.filter("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("_skm_doc"), F.xxhash64("text").alias("_skm_text"), "text")
    packed = stage(wanted.join(bodies, ["_skm_doc", "_skm_text"]).select("text", "wanted", "_skm_doc").mapInArrow(
        W.lean(lambda it: _pack(it, width)), "minimiser long, k1 long, k2 long, doc long, packed binary")
        .join(sizes, "minimiser").dropDuplicates(["minimiser", "k1", "k2"]))

    columns = ["minimiser", "k1", "k2", "doc", "packed"]
    normal = (packed.filter(F.col("count") <= hot).select(columns)
              .repartition("minimiser").sortWithinPartitions("minimiser")
              .mapInArrow(W.lean(lambda it: _sort_buckets(it, width)), "k1 long, k2 long, doc long, least array<long>"))
    results = [stretches.join(sizes, "minimiser", "left_anti")
               .select("k1", "k2", F.col("_skm_doc").alias("doc"), F.lit(None).cast("array<long>").alias("least")), normal]
    if not packed.filter(F.col("count") > hot).isEmpty():
        windows = stage(packed.filter(F.col("count") > hot).select(columns).mapInArrow(
            W.lean(lambda it: _unpack_hot(it, width)), "k1 long, k2 long, doc long, at int, high long, low long"))
        least = stage(windows.groupBy("high", "low").agg(F.min("doc").alias("least")))
        results.append(windows.join(least, ["high", "low"]).groupBy("k1", "k2", "doc").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("at", "least"))), lambda w: w["least"]).alias("least")))
    judged = results[0]
    for more in results[1:]:
        judged = judged.unionByName(more)
    judged = stage(judged)

    earlier = F.when(F.col("least").isNotNull(), F.filter(
        F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get(F.col("least"), i) < F.col("_skm_doc")))
    return (spots.join(judged, ["k1", "k2"])
            .filter((F.col("doc") < F.col("_skm_doc")) | F.exists("least", lambda d: d < F.col("_skm_doc")))
            .select("_skm_doc", "_skm_text", "at", "n",
                    F.when((F.col("least").isNull()) | (F.size(earlier) < F.col("n")), earlier).alias("hits")))


def _removed(pieces: list[dict], n_words: int, width: int) -> np.ndarray:
    """Which words a hit window covers."""
    change = np.zeros(n_words + 1, dtype=np.int32)
    for piece in pieces:
        if piece["hits"] is None:
            change[piece["at"]] += 1
            change[piece["at"] + piece["n"] + width - 1] -= 1
        else:
            begin = np.array(piece["hits"]) + piece["at"]
            np.add.at(change, begin, 1)
            np.add.at(change, begin + width, -1)
    return np.cumsum(change[:-1]) > 0


def remove_repeats(docs: DataFrame, stage: Stage, width: int = 50, seed_words: int = 8,
                   hot: int = HOT_STRETCHES) -> DataFrame:
    """All rows and columns of ``docs`` with the text shortened, and ``n_words``, ``n_removed``, ``kept_sha256``.

    A word goes if some window that covers it also starts in a document with a smaller
    ``doc_id``; windows are those of the input.  Where nothing goes the text stays as it
    is, else the kept words are joined by one space.  ``kept_sha256`` always hashes the
    joined words.  The three results replace columns of their names.  ``stage`` keeps
    intermediate tables, see ``tiffin.session.Stage``.
    """
    hits = covered_windows(docs, stage, width, seed_words, hot).groupBy("_skm_doc", "_skm_text").agg(
        F.collect_list(F.struct("at", "n", "hits")).alias("_skm_hits"))
    keyed = docs.withColumns({"_skm_doc": F.col("doc_id").cast("long"), "_skm_text": F.xxhash64("text")})
    joined = keyed.join(hits, ["_skm_doc", "_skm_text"], "left").drop("_skm_doc", "_skm_text")
    kept = [c for c in docs.columns if c not in ("n_words", "n_removed", "kept_sha256")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                texts = part.column(kept.index("text")).to_pylist()
                found = part.column(len(kept)).to_pylist()
                out, n_words, n_removed, digests = [], [], [], []
                for text, pieces in zip(texts, found, strict=True):
                    body = (text or "").encode().split()
                    total, gone = len(body), 0
                    if pieces:
                        covered = _removed(pieces, total, width)
                        gone = int(covered.sum())
                        body = [w for w, c in zip(body, covered, strict=True) if not c]
                    joined_words = b" ".join(body)
                    out.append(joined_words.decode() if gone else text)
                    n_words.append(total)
                    n_removed.append(gone)
                    digests.append(hashlib.sha256(joined_words).hexdigest())
                arrays = [pa.array(out, pa.string()) if c == "text" else part.column(i) for i, c in enumerate(kept)]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string())],
                    names=[*kept, "n_words", "n_removed", "kept_sha256"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in kept)
    return joined.select(*[F.col(f"`{c}`") for c in kept], "_skm_hits").mapInArrow(
        W.lean(run), f"{fields}, n_words long, n_removed long, kept_sha256 string")
