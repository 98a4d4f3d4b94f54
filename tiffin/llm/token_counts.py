"""Token counts without tokens: a Viterbi pass that carries only the best score and its number of pieces.

The vocabulary is a unigram model fitted on a sample of the texts by the ``sentencepiece`` trainer
(``fit_unigram``), so scores are log-probabilities.  The sample is bounded whatever the size of the
table: of at most ``SAMPLE`` different texts, the first in order of a hash, one stretch of at most
``STRETCH`` code points each.  It teaches the vocabulary only; every text is counted whole.

A path is a ``sentencepiece`` file of any kind (merge ranks of a BPE file are no log-probabilities);
its pieces are counted by the file's own ``encode``.

An Aho-Corasick automaton finds the pieces that end at each character.  Of the ways to reach a
character the one with the highest sum of scores stands; of equal ones the one whose last piece
starts first, as unigram tokenizers decide.  A character that is no piece by itself may also be
unknown, ten below the lowest score, and then counts as its UTF-8 bytes.

A text is its characters with every space written as U+2581 and one more in front.  No piece
holds that mark after another character, so the runs that begin with it are independent and a
worker remembers their counts.

Rows: a null or empty text has 0 tokens.  Repeated rows are counted one by one.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBERED = 1_000_000
SAMPLE = 4000
STRETCH = 4000
PIECES = 32_000
#: Code points of a training sentence; the trainer skips sentences above 8192 bytes.
_SENTENCE = 2000
#: Printable ASCII is always taught, so that a small table has a vocabulary too.
_ALPHABET = " ".join(map(chr, range(33, 127)))
MARK = "▁"
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


class Counter:
    """Counts pieces by ``(piece, score)`` pairs."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self._automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"piece {piece!r} holds the space mark inside")
            self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._unknown = min(score for _, score in pieces) - 10.0
        self._known: dict[str, int] = {}

    def run(self, text: str) -> int:
        """Pieces of the best way through ``text``."""
        found: list[list[tuple[int, float]]] = [[] for _ in range(len(text) + 1)]
        for last, match in self._automaton.iter(text):
            found[last + 1].append(match)
        score, count = [0.0], [0]
        for end in range(1, len(text) + 1):
            best, pieces, single = None, 0, False
            for length, value in sorted(found[end], reverse=True):
                reached = score[end - length] + value
                if best is None or reached > best:
                    best, pieces = reached, count[end - length] + 1
                single = single or length == 1
            if not single:
                reached = score[end - 1] + self._unknown
                if best is None or reached > best:
                    best, pieces = reached, count[end - 1] + len(text[end - 1].encode())
            score.append(best)
            count.append(pieces)
        return count[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, total = self._known, 0
        for run in _RUNS.findall(MARK + text.replace(" ", MARK)):
            n = known.get(run)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[run] = self.run(run)
            total += n
        return total


def sample_texts(docs: DataFrame, sample: int = SAMPLE, stretch: int = STRETCH, seed: int = 7) -> list[str]:
    """A stretch of each of at most ``sample`` different texts of ``docs``, chosen and placed by their hash."""
    keyed = docs.filter("text <> ''").select("text", F.xxhash64(F.lit(seed), "text").alias("place"))
    chosen = keyed.select("place").distinct().orderBy("place").limit(sample)
    begin = F.pmod("place", F.greatest(F.char_length("text") - stretch, F.lit(0)) + 1).cast("int") + 1
    stretches = keyed.join(F.broadcast(chosen), "place").select("place", F.substring("text", begin, F.lit(stretch)).alias("text"))
    return [r.text for r in stretches.groupBy("place").agg(F.min("text").alias("text")).orderBy("place").collect()]


def fit_unigram(texts: list[str], pieces: int = PIECES) -> bytes:
    """A ``sentencepiece`` unigram model of at most ``pieces`` pieces; texts are taken as they are, unknown characters as bytes."""
    import sentencepiece
    lines = (line[i:i + _SENTENCE] for text in texts for line in re.split("[\t\n\0]", text) for i in range(0, len(line), _SENTENCE))
    made = io.BytesIO()
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter([_ALPHABET, *(line for line in lines if line.strip())]), model_writer=made, model_type="unigram",
        vocab_size=pieces, hard_vocab_limit=False, byte_fallback=True, normalization_rule_name="identity",
        remove_extra_whitespaces=False, max_sentence_length=4 * _SENTENCE + 192, num_threads=4, minloglevel=2)
    return made.getvalue()


@lru_cache(maxsize=2)
def counter(vocabulary: str | bytes) -> Callable[[str | None], int]:
    """Counts the pieces of a text: by a fitted unigram model, or by the file at a path."""
    import sentencepiece
    if isinstance(vocabulary, str):
        encode = sentencepiece.SentencePieceProcessor(model_file=vocabulary).encode
        return lambda text: len(encode(text)) if text else 0
    model = sentencepiece.SentencePieceProcessor(model_proto=vocabulary)
    return Counter([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
                    if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]).count


def token_counts(docs: DataFrame, vocabulary: str | bytes) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of every row of ``docs`` (doc_id, text), by a fitted model or the path of a file."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(sent.value)
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                counts = [count(text) for text in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
