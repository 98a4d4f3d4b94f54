"""Documents packed into fixed-length token sequences: first-fit decreasing in randomised groups.

Every document is tokenized whole and closed with ``end_id``.  Full sequences are cut
off first; what is left (less than ``length`` tokens) is packed by first-fit decreasing.
The first bin with room is found by walking a tournament tree whose nodes hold the
largest room below them, so an item costs the logarithm of the number of bins.  Groups
of about ``group_items`` items are drawn by a hash of the item's place in the staged
table, so they are alike in content and size, no key fills one, and each is packed in
one task on lengths alone.

Rows: a null or empty text is just ``end_id``.  Repeated rows are packed one by one.
Empty tables give no pieces.
"""

from __future__ import annotations

import codecs
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm import words as W

Stage = Callable[[DataFrame], DataFrame]

#: Words and parts whose ids a worker remembers before it starts afresh, about 130 bytes each.
REMEMBERED = 600_000
#: Bytes of text whose parts are looked up together.
TOGETHER = 1 << 22
GROUP_ITEMS = 50_000
#: White space that the tokenizer drops wherever it stands, so ids of the parts between are independent.
_IN_PART = np.ones(256, dtype=bool)
_IN_PART[[0x20, 0x09, 0x0A, 0x0D]] = False
#: Letters that stay as they are but for their case when normalised, and ASCII marks behind them: a word to the
#: pre-tokenizer and, where there are marks, one more.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


def _byte_characters() -> str:
    """The character that stands for each byte in a byte-level vocabulary: itself where it can be
    printed, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


_BYTE_CHARACTERS = _byte_characters()


class Encoder:
    """Ids of texts by a ``tokenizers`` file with a byte-level pre-tokenizer that drops white space.

    Parts between white space are encoded by the library once and remembered, since no
    token spans white space; ids are those of the whole text.  The distinct parts of some
    megabytes of text are found as arrays; of those that are plain letters with marks
    behind them, the lower-case letters and the marks are looked up apart.  A word of
    Latin letters goes straight to the library's model.
    """

    def __init__(self, path: str, remembered: int | None = None):
        from tokenizers import Tokenizer
        self._most = remembered or REMEMBERED
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._normalize = self._tokenizer.normalizer.normalize_str
        self.forget()

    def forget(self) -> None:
        self._ids: dict[bytes, bytes] = {b"": b""}

    def _whole(self, part: str) -> bytes:
        return array("I", self._tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def _word(self, letters: str) -> bytes | None:
        """Ids of one word of Latin letters, None if it may be anything else to the pre-tokenizer."""
        if not letters.isalpha():
            return None
        plain = letters.lower() if letters.isascii() else self._normalize(letters)
        if not plain.isascii() and (not plain.isalpha() or max(plain) >= "\u0250"):
            return None
        mapped = codecs.charmap_decode(plain.encode(), "strict", _BYTE_CHARACTERS)[0]
        return array("I", [t.id for t in self._model.tokenize(mapped)]).tobytes()

    def _learn(self, raw: bytes) -> bytes:
        part = raw.decode()
        letters = part[:-1] if part[-1] in ",." else part
        found = self._word(letters)
        if found is None:
            found = self._whole(part)
        elif letters != part:
            found += self._whole(part[-1])
        self._ids[raw] = found
        return found

    def _known(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts."""
        found = list(map(self._ids.get, parts))
        if len(self._ids) > self._most:
            self.forget()
        return [self._learn(part) if ids is None else ids for part, ids in zip(parts, found, strict=True)]

    def _look_up(self, parts: pa.Array) -> pa.Array:
        """Ids of distinct parts, of plain letters and the marks behind them apart."""
        cut = pc.extract_regex(parts, _PLAIN)
        letters = pc.coalesce(pc.utf8_lower(pc.struct_field(cut, "letters")), parts)
        marks = pc.coalesce(pc.struct_field(cut, "marks"), pa.scalar("", parts.type))
        ids = []
        for some in (letters.dictionary_encode(), marks.dictionary_encode()):
            found = self._known(some.dictionary.cast(pa.large_binary()).to_pylist())
            ids.append(pa.array(found, pa.large_binary()).take(some.indices))
        return pc.binary_join_element_wise(*ids, pa.scalar(b"", pa.large_binary()))

    def encode_together(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each of the UTF-8 texts that lie one after another in ``data``."""
        parts = W.split(data, offsets, word_bytes=_IN_PART)
        if not len(parts.starts):
            return [b""] * (len(offsets) - 1)
        ends = np.append(0, np.cumsum(parts.ends - parts.starts))
        flat = pa.Array.from_buffers(pa.large_string(), len(ends) - 1, [
            None, pa.py_buffer(ends), pa.py_buffer(parts.data[_IN_PART[parts.data]])])
        coded = flat.dictionary_encode()
        taken = self._look_up(coded.dictionary).take(coded.indices)
        at = np.frombuffer(taken.buffers()[1], dtype=np.int64)[taken.offset:][parts.first].tolist()
        whole = memoryview(taken.buffers()[2])
        return [bytes(whole[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.large_string())], names=["text"])
        for _, data, offsets in W.chunks(iter([batch]), limit=TOGETHER):
            yield from self.encode_together(data, offsets)


@lru_cache(maxsize=2)
def encoder(path: str, remembered: int) -> Encoder:
    return Encoder(path, remembered)


def pieces(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, keep_ids: bool = False,
           remembered: int = REMEMBERED) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens`` per piece (and ``ids``), cut every ``length`` tokens.

    A worker remembers the ids of at most ``remembered`` words and parts, about 130 bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        made = encoder(tokenizer, remembered)
        W.remember("packing", made.forget)
        end = np.array([end_id], dtype="<u4").tobytes()
        for part, data, offsets in W.chunks(batches, limit=TOGETHER):
            rows, at, size, crc, total, ids = [], [], [], [], [], []
            for i, body in enumerate(made.encode_together(data, offsets)):
                body += end
                for start in range(0, len(body), 4 * length):
                    cut = body[start:start + 4 * length]
                    rows.append(i)
                    at.append(start // 4)
                    size.append(len(cut) // 4)
                    crc.append(zlib.crc32(cut))
                    total.append(len(body) // 4)
                    if keep_ids:
                        ids.append(cut)
            arrays = [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, pa.int64()) for c in (at, size, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids binary" if keep_ids else "")
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(W.lean(run, "packing"), schema)


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place in the bin of each item; items in order of size, ties in the given order."""
    leaves = 1 << max(len(sizes) - 1, 1).bit_length()
    room = [capacity] * (2 * leaves)
    bins = np.empty(len(sizes), dtype=np.int64)
    places = np.empty(len(sizes), dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    for item, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        node = 1
        while node < leaves:
            node *= 2
            if room[node] < size:
                node += 1
        bins[item], places[item] = node - leaves, capacity - room[node]
        room[node] -= size
        node >>= 1
        while node:
            best = room[2 * node] if room[2 * node] >= room[2 * node + 1] else room[2 * node + 1]
            if room[node] == best:
                break
            room[node] = best
            node >>= 1
    return bins, places


def pack(made: DataFrame, stage: Stage, length: int = 4096, seed: int = 7, group_items: int = GROUP_ITEMS) -> DataFrame:
    """The rows of ``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 in each sequence).

    Sequence ids of group g start at g * 2**32, those of full pieces at 2**62; a full piece is a sequence by itself.
    """
    placed = stage(made.withColumn("_pack_row", F.monotonically_increasing_id()))
    count = placed.filter(F.col("length") < length).count()
    groups = max(1, -(-count // group_items))
    full = placed.filter(F.col("length") >= length).withColumns({
        "sequence_id": F.lit(1 << 62) + F.col("_pack_row"), "offset": F.lit(0).cast("long")})
    items = placed.filter(F.col("length") < length).select("_pack_row", "length").withColumn(
        "group", F.pmod(F.xxhash64(F.lit(seed), "_pack_row"), F.lit(groups)))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_pack_row")
        bins, places = first_fit_decreasing(rows["length"].to_numpy(), length)
        return pd.DataFrame({"_pack_row": rows["_pack_row"], "sequence_id": rows["group"] * (1 << 32) + bins, "offset": places})

    fitted = items.groupBy("group").applyInPandas(fit, "_pack_row long, sequence_id long, offset long")
    rest = placed.filter(F.col("length") < length).join(fitted, "_pack_row")
    return rest.unionByName(full).drop("_pack_row")
