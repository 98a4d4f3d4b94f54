"""Byte-level BPE: texts to ids and ids to bytes, with a two-tier look-up.

A text is split into pre-tokens by the pattern of the vocabulary, and every pre-token is
encoded by itself.  First tier: a minimal perfect hash gives each token of the vocabulary
its own slot, so one probe and one comparison tell whether a pre-token is a token as it
stands; the distinct pre-tokens of a chunk of texts are hashed together as arrays.  Second
tier: the bytes of any other pre-token form a linked list, and a heap of neighbouring pairs,
lowest rank first and leftmost among equals, says which pair joins next; the first pairs of
all pre-tokens of a chunk are ranked together as arrays.

The vocabulary and its hash are made once on the driver and travel with the job (about a
megabyte); texts never leave their partition and nothing is shuffled.  A worker remembers
the ids of about ``REMEMBERED`` short pre-tokens and words, from task to task, and forgets
them when another operator's task begins in it.

Rows: a null or empty text has no ids and decodes to no bytes.  Long texts are split in
steps, so a task holds the ids of one text, not all its pre-tokens.  Repeated rows are
encoded one by one; empty tables give none.  A column named like a result is replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm import words as W

#: Pre-tokens and words of up to ``SHORT`` characters that a worker remembers before it starts afresh, about 200 bytes each.
REMEMBERED = 600_000
SHORT = 48
#: The pattern after which texts can be cut at spaces: white space joins the next pre-token only as one space before it.
SPACE_LED = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BEFORE_OTHERS = re.compile(r" (?=\S)")
_BEFORE_SPACE = re.compile(r" (?!\S)")
#: Pre-tokens of a long text that are handled at a time.
STEP = 50_000
#: Pre-tokens of up to ``TOGETHER`` bytes have their heaps begun together, ``BATCH`` at a time; arrays do not pay for a ``FEW``.
TOGETHER = 63
BATCH = 4096
FEW = 64
_TRIES = 64
_STEP_HASH = W.U64(0x9E3779B97F4A7C15)


def _hashed(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each key."""
    ends = np.cumsum([len(k) for k in keys])
    starts = np.append(0, ends[:-1])
    flat = W.Words(np.frombuffer(b"".join(keys), dtype=np.uint8), starts, ends, np.array([0, len(keys)]))
    return flat.hashes(W.BASES[0]), flat.hashes(W.BASES[1])


@dataclass
class PerfectHash:
    """``slots(keys)`` are 0 to n - 1, all different, for the n keys it was built from; other keys get any slot.

    Keys fall into buckets of about four.  Large buckets first, each looks for the first
    displacement that sends its keys to free slots; buckets of one key take what is left
    and note the slot itself (negative).
    """

    shifts: np.ndarray
    size: int

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        size = len(keys)
        count = max(1, size // 4)
        shifts = np.zeros(count, dtype=np.int64)
        if not size:
            return cls(shifts, 0)
        one, two = _hashed(keys)
        bucket = (one % W.U64(count)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        filled, begins, sizes = np.unique(bucket[order], return_index=True, return_counts=True)
        free = np.ones(size, dtype=bool)
        for at in np.argsort(-sizes, kind="stable").tolist():
            members = order[begins[at]:begins[at] + sizes[at]]
            if len(members) == 1:
                break
            for first in range(1, 1 << 22, _TRIES):
                tried = cls._places(two[members][None, :], np.arange(first, first + _TRIES)[:, None], size)
                good = free[tried].all(axis=1)
                ranked = np.sort(tried, axis=1)
                good &= (ranked[:, 1:] != ranked[:, :-1]).all(axis=1)
                if good.any():
                    found = int(np.argmax(good))
                    shifts[filled[at]] = first + found
                    free[tried[found]] = False
                    break
            else:
                raise ValueError("keys repeat")
        single = filled[sizes == 1]
        shifts[single] = -np.flatnonzero(free) - 1
        return cls(shifts, size)

    @staticmethod
    def _places(hashes: np.ndarray, shift: np.ndarray, size: int) -> np.ndarray:
        return (W.mix(hashes ^ (shift.astype(W.U64) * _STEP_HASH)) % W.U64(size)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        if not self.size or not keys:
            return np.zeros(len(keys), dtype=np.int64)
        one, two = _hashed(keys)
        shift = self.shifts[(one % W.U64(len(self.shifts))).astype(np.int64)]
        return np.where(shift < 0, -shift - 1, self._places(two, np.maximum(shift, 0), self.size))


def _merged(piece: bytes, ranks: dict[bytes, int], heap: list[int], ids: list[int], width: int) -> list[int]:
    """Ids of one pre-token: the neighbouring pair of lowest rank joins, leftmost first, until none has a rank.

    A heap entry is one number: the rank, then where the pair begins and ends, ``width`` bits each.
    The heap has the pairs of neighbouring bytes and ``ids`` the bytes' own ids; both are used up.
    """
    size, rank_of, push, pop = len(piece), ranks.get, heapq.heappush, heapq.heappop
    after = [*range(1, size + 1), -1]  # -1: joined another, or the end
    before = [*range(-1, size)]
    heapq.heapify(heap)
    mask = (1 << width) - 1
    while heap:
        entry = pop(heap)
        end, i = entry & mask, entry >> width & mask
        middle = after[i]
        if after[middle] != end:
            continue  # one of the two has joined another since
        after[i], after[middle], before[end] = end, -1, i
        ids[i] = entry >> 2 * width
        if end < size:
            far = after[end]
            rank = rank_of(piece[i:far])
            if rank is not None:
                push(heap, (rank << width | i) << width | far)
        if i:
            left = before[i]
            rank = rank_of(piece[left:end])
            if rank is not None:
                push(heap, (rank << width | left) << width | end)
    return [found for found, end in zip(ids, after[:size], strict=True) if end >= 0]


def joined_by_rank(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token, whose bytes are looked up one by one."""
    size, rank_of = len(piece), ranks.get
    width = size.bit_length()
    heap = []
    for i in range(size - 1):
        rank = rank_of(piece[i:i + 2])
        if rank is not None:
            heap.append((rank << width | i) << width | i + 2)
    out = _merged(piece, ranks, heap, [rank_of(piece[i:i + 1]) for i in range(size)], width)
    if None in out:
        raise KeyError(f"a byte of {piece!r} has no rank")
    return out


class Joiner:
    """Ids of many pre-tokens: the heaps of those of up to ``TOGETHER`` bytes are begun as arrays, the others one by one."""

    def __init__(self, ranks: dict[bytes, int]):
        self._ranks = ranks
        self._one = np.array([ranks.get(bytes([b]), -1) for b in range(256)], dtype=np.int64)
        self._two = np.full(1 << 16, -1, dtype=np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self._two[token[0] << 8 | token[1]] = rank

    def joined(self, pieces: list[bytes]) -> list[list[int]]:
        short = [p for p in pieces if 0 < len(p) <= TOGETHER]
        if len(short) < FEW or self._one.min() < 0:
            return [joined_by_rank(p, self._ranks) for p in pieces]
        made = chain.from_iterable(self._begun(short[at:at + BATCH]) for at in range(0, len(short), BATCH))
        return [next(made) if 0 < len(p) <= TOGETHER else joined_by_rank(p, self._ranks) for p in pieces]

    def _begun(self, pieces: list[bytes]) -> Iterator[list[int]]:
        width = TOGETHER.bit_length()
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        begins = np.append(0, ends)
        place = np.arange(len(flat)) - np.repeat(begins[:-1], np.diff(begins))
        rank = np.append(self._two[flat[:-1] << 8 | flat[1:]], -1)
        rank[ends - 1] = -1  # the next byte is another piece's
        at = np.flatnonzero(rank >= 0)
        entries = ((rank[at] << width | place[at]) << width | place[at] + 2).tolist()
        heaps, ids, bounds = np.searchsorted(at, begins).tolist(), self._one[flat].tolist(), begins.tolist()
        for k, piece in enumerate(pieces):
            yield _merged(piece, self._ranks, entries[heaps[k]:heaps[k + 1]], ids[bounds[k]:bounds[k + 1]], width)


@dataclass
class Vocabulary:
    """Tokens and ids by slot of the perfect hash, the pattern of pre-tokens, and a name that tells vocabularies apart."""

    tokens: list[bytes]
    ids: list[int]
    perfect: PerfectHash
    pattern: str
    name: str

    @classmethod
    def build(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        keys = sorted(ranks)
        perfect = PerfectHash.build(keys)
        by_slot = [b""] * len(keys)
        for key, slot in zip(keys, perfect.slots(keys).tolist(), strict=True):
            by_slot[slot] = key
        name = hashlib.sha256(repr((pattern, [(k, ranks[k]) for k in keys])).encode()).hexdigest()
        return cls(by_slot, [ranks[k] for k in by_slot], perfect, pattern, name)

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """From a rank file: a token in base64 and its rank a line."""
        with open(path, "rb") as lines:
            return cls.build({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}, pattern)

    def by_id(self) -> dict[int, bytes]:
        return dict(zip(self.ids, self.tokens, strict=True))


class Encoder:
    """Ids of texts; remembers short pre-tokens and what stands between spaces, about ``REMEMBERED`` together.

    With the pattern ``SPACE_LED`` a pre-token begins at every space that other than white space follows, and
    nothing before such a space or behind it changes what the pattern finds on the other side.  So texts are cut
    there, and a stretch that was met before is neither matched nor encoded again.
    """

    def __init__(self, vocabulary: Vocabulary):
        import regex
        self._pieces = regex.compile(vocabulary.pattern)
        self._cut = vocabulary.pattern == SPACE_LED
        self._vocabulary = vocabulary
        self._joiner = Joiner(dict(zip(vocabulary.tokens, vocabulary.ids, strict=True)))
        self.forget()

    def forget(self) -> None:
        self._alone: dict[str, bytes] = {"": b""}
        self._spaced: dict[str, bytes] = {}  # by what follows a space; the ids are those with the space
        self._long: list[tuple[dict[str, bytes], str]] = []

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens: those that are tokens by the perfect hash, others by joining."""
        raw = [p.encode() for p in pieces]
        tokens, ids = self._vocabulary.tokens, self._vocabulary.ids
        found = [[ids[slot]] if tokens and tokens[slot] == piece else None
                 for piece, slot in zip(raw, self._vocabulary.perfect.slots(raw).tolist(), strict=True)]
        joined = iter(self._joiner.joined([p for p, one in zip(raw, found, strict=True) if one is None]))
        found = [one or next(joined) for one in found]
        flat = array("i", chain.from_iterable(found)).tobytes()
        ends = [4 * end for end in accumulate(map(len, found))]
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _keep(self, store: dict[str, bytes], key: str, ids: bytes) -> None:
        store[key] = ids
        if len(key) > SHORT:
            self._long.append((store, key))

    def _place(self, piece: str) -> tuple[dict[str, bytes], str]:
        """Where the ids of a pre-token are remembered."""
        if piece[0] == " " and not piece[1:2].isspace() and len(piece) > 1:
            return self._spaced, piece[1:]
        return self._alone, piece

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens; all that are new are looked up together."""
        ids, new = {}, {}
        for piece in dict.fromkeys(pieces):
            store, key = place = self._place(piece)
            known = store.get(key)
            if known is None:
                new[piece] = place
            else:
                ids[piece] = known
        for (piece, (store, key)), made in zip(new.items(), self._look_up(list(new)), strict=True):
            ids[piece] = made
            self._keep(store, key, made)
        return [ids[p] for p in pieces]

    def _learn(self, alone: list[str], spaced: list[str]) -> None:
        """Ids of new stretches, those of ``spaced`` with a space before them, which are matched as one text."""
        pieces = [p for s in alone for p in self._pieces.findall(s)]
        pieces += self._pieces.findall("".join([f" {s}" for s in spaced]))
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        sizes = [*map(len, alone), *(len(s) + 1 for s in spaced)]
        bounds = np.searchsorted(ends, np.cumsum(sizes, dtype=np.int64), side="right").tolist()
        ids, begin = self._joined(pieces), 0
        for i, (stretch, end) in enumerate(zip([*alone, *spaced], bounds, strict=True)):
            self._keep(self._alone if i < len(alone) else self._spaced, stretch,
                       ids[begin] if end - begin == 1 else b"".join(ids[begin:end]))
            begin = end

    def _tidy(self) -> None:
        """Forget what is long, and start afresh when too much is remembered."""
        for store, key in self._long:
            store.pop(key, None)
        self._long.clear()
        if len(self._alone) + len(self._spaced) > REMEMBERED:
            self.forget()

    def _in_steps(self, text: str) -> bytes:
        found = self._pieces.finditer(text)
        parts = []
        while pieces := [m.group() for m in islice(found, STEP)]:
            parts.append(b"".join(self._joined(pieces)))
            self._tidy()
        return b"".join(parts)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; a long one, or any with another pattern, is taken in steps."""
        out: list[bytes] = [b""] * len(texts)
        cut: dict[int, list[str]] = {}
        for i, text in enumerate(texts):
            if not self._cut or len(text) > STEP:
                out[i] = self._in_steps(text)
            else:
                cut[i] = _BEFORE_OTHERS.split(text) if _BEFORE_SPACE.search(text) else text.split(" ")
        alone, spaced = self._alone, self._spaced
        firsts = [stretches.pop(0) for stretches in cut.values()]
        self._learn(list(dict.fromkeys(s for s in firsts if s not in alone)),
                    list(dict.fromkeys(s for stretches in cut.values() for s in stretches if s not in spaced)))
        for first, (i, stretches) in zip(firsts, cut.items(), strict=True):
            out[i] = alone[first] + b"".join(map(spaced.__getitem__, stretches))
        self._tidy()
        return [np.frombuffer(ids, dtype=np.int32) for ids in out]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]


_encoders: dict[str, Encoder] = {}


def _worker_encoder(vocabulary: Vocabulary) -> Encoder:
    """The encoder of this worker, which keeps what it remembers from task to task of one vocabulary."""
    if vocabulary.name not in _encoders:
        _encoders.clear()
        _encoders[vocabulary.name] = Encoder(vocabulary)
    return _encoders[vocabulary.name]


def _kept(docs: DataFrame, results: tuple[str, ...], columns: list[str] | None) -> list[str]:
    return [c for c in (columns or docs.columns) if c not in results]


def encode(docs: DataFrame, vocabulary: Vocabulary, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of every row of ``docs`` (default: all) and its ``ids``, those of the whole ``text``."""
    names = _kept(docs, ("ids",), columns)
    types = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tiffin.llm import byte_bpe
        encoder = byte_bpe._worker_encoder(vocabulary)
        W.remember("byte_bpe", byte_bpe._encoders.clear)
        for batch, data, offsets in W.chunks(batches, "_bpe_text"):
            base = (offsets - offsets[0]).tolist()
            whole = data.tobytes()
            made = encoder.encode_all([whole[a:b].decode() for a, b in zip(base[:-1], base[1:], strict=True)])
            ids = np.concatenate(made) if made else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(names))), W.lists(ids, np.array([len(m) for m in made]), pa.int32())],
                names=[*names, "ids"])

    fields = "".join(f"`{c}` {types[c]}, " for c in names)
    return docs.select(*[F.col(f"`{c}`") for c in names], F.col("text").alias("_bpe_text")).mapInArrow(
        W.lean(run, "byte_bpe"), f"{fields}ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of every row (default: all) and ``decoded``, the bytes of its ``ids`` (null: none).

    An id outside the vocabulary, or a null in the list, makes ``decoded`` null: such a list is no text's."""
    names = _kept(encoded, ("decoded",), columns)
    types = dict(encoded.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = vocabulary.by_id()
        none = max(token, default=-1) + 1
        table = pa.array([token.get(i, b"") for i in range(none + 1)], pa.large_binary())
        known = np.zeros(none + 1, dtype=bool)
        known[list(token)] = True
        for batch in batches:
            for begin in range(0, batch.num_rows, 200):
                part = batch.slice(begin, 200)
                rows = part.column(part.num_columns - 1)
                counts = np.array(rows.value_lengths().fill_null(0), dtype=np.int64)
                flat = rows.flatten()
                ids = np.array(flat.fill_null(-1), dtype=np.int64)
                ids[(ids < 0) | (ids > none)] = none
                ends = np.append(0, np.cumsum(counts))
                lost = np.append(0, np.cumsum(~known[ids]))
                taken = table.take(pa.array(ids))
                at = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset:][ends] if len(ids) else ends
                whole = taken.buffers()[2].to_pybytes() if len(ids) else b""
                out = [whole[a:b] if sound else None for a, b, sound in zip(
                    at[:-1].tolist(), at[1:].tolist(), (lost[ends[1:]] == lost[ends[:-1]]).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), pa.array(out, pa.binary())],
                                                 names=[*names, "decoded"])

    fields = "".join(f"`{c}` {types[c]}, " for c in names)
    return encoded.select(*[F.col(f"`{c}`") for c in names], F.col("ids").alias("_bpe_ids")).mapInArrow(
        W.lean(run, "byte_bpe"), f"{fields}decoded binary")
