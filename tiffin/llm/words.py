"""Words of whole texts as flat arrays, for use inside Arrow tasks.

A word is ``[^\\x20\\x09-\\x0D]+`` on the UTF-8 bytes of a text.  Texts of one Arrow
batch are handled in chunks of about half a megabyte, so the memory of a task does
not depend on the batch or on the table; only a single longer text enlarges it.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U64 = np.uint64

_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse modulo 2**64."""
    def run(factor: int) -> np.ndarray:
        steps = np.full(size, factor, dtype=U64)
        steps[0] = 1
        return np.multiply.accumulate(steps)
    return run(base), run(pow(base, -1, 1 << 64))


_known_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The longest powers so far are kept for each base, up to twice a chunk; those for a very long text are not."""
    made = _known_powers.get(base)
    if made is None or len(made[0]) < size:
        room = 1 << max(int(size - 1).bit_length(), 12)
        made = _powers(base, room if room <= 2 * CHUNK_BYTES else size)
        if room <= 2 * CHUNK_BYTES:
            _known_powers[base] = made
    return made[0][:size], made[1][:size]


_forgetting: dict[str, Callable[[], None]] = {}


def remember(owner: str, forget: Callable[[], None]) -> None:
    """What an operator keeps in a worker between its tasks goes when another operator's task begins there."""
    _forgetting[owner] = forget


def begin_task(owner: str) -> None:
    for name in [n for n in _forgetting if n != owner]:
        _forgetting.pop(name)()


def end_task() -> None:
    """Give freed memory back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator], owner: str = "") -> Callable[[Iterator], Iterator]:
    """``run`` as an Arrow task that leaves no more memory behind than its operator asks to ``remember``."""
    def task(batches: Iterator) -> Iterator:
        from tiffin.llm import words
        words.begin_task(owner)
        try:
            yield from run(batches)
        finally:
            words.end_task()
    return task


@dataclass
class Words:
    """Words of several documents: word i is ``data[starts[i]:ends[i]]``; document d
    has the words ``first[d]:first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, base: int = BASES[0]) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        up, down = powers(base, len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, dtype=U64)
        np.cumsum((self.data.astype(U64) + U64(1)) * up[:-1], out=total[1:])
        sums = (total[self.ends] - total[self.starts]) * down[self.starts]
        return mix(sums + (self.ends - self.starts).astype(U64) * U64(base))

    def document(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


#: Bytes of letters: A-Z, a-z and all of other scripts.
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def split(data: np.ndarray, offsets: np.ndarray, lower: bool = False, word_bytes: np.ndarray = _IS_WORD) -> Words:
    """The words of documents that lie one after another in ``data``."""
    offsets = offsets - offsets[0]
    if lower:
        data = _LOWER[data]
    size = len(data)
    if size == 0:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, none, none, np.zeros(len(offsets), dtype=np.int64))
    word = word_bytes[data]
    before = np.zeros(size, dtype=bool)
    before[1:] = word[:-1]
    after = np.zeros(size, dtype=bool)
    after[:-1] = word[1:]
    edges = offsets[(offsets > 0) & (offsets < size)]
    before[edges] = False
    after[edges - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def rolling(hashes: np.ndarray, width: int, base: int = BASES[1]) -> np.ndarray:
    """A hash of every ``width`` consecutive values; shorter by ``width - 1``."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(width):
        out = out * U64(base) + hashes[j:j + n]
    return mix(out)


def stretches(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A hash of each stretch ``hashes[start:end]``, of any lengths."""
    up, down = powers(base, len(hashes) + 1)
    total = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * up[:-1], out=total[1:])
    sums = (total[ends] - total[starts]) * down[starts]
    return mix(sums + (ends - starts).astype(U64) * U64(base))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` consecutive values."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[:n], values[width - span:width - span + n])


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text",
           limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the UTF-8 bytes and offsets of their texts (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        raw = column.buffers()
        offsets = np.frombuffer(raw[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
        data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.zeros(0, dtype=np.uint8)
        begin = 0
        while begin < len(column):
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), len(column))
            yield batch.slice(begin, end - begin), data[offsets[begin]:offsets[end]], offsets[begin:end + 1]
            begin = end


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's signed long."""
    return values.view(np.int64)


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per row from the flat values."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
