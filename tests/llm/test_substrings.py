import hashlib
import random

import numpy as np
import pytest

from plain import plain_words
from tiffin.llm import substrings
from tiffin.session import Stage


def brute(rows, width):
    """Windows of every document in plain Python."""
    first = {}
    words = [(d, plain_words(t)) for d, t in rows]
    for d, w in words:
        for i in range(len(w) - width + 1):
            key = tuple(w[i:i + width])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, w in words:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def texts(seed):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(40)]
    out = []
    for i in range(60):
        body = [rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            at, cut = rng.randint(0, len(body)), rng.randint(0, 15)
            body[at:at] = passage[cut:40 - rng.randint(0, 10)]
        out.append(rng.choice([" ", "\n", "\t "]).join(body))
    return [*out, out[3], out[3], out[4] + " tail", "", None, "x " * 3000, "x " * 2000]


@pytest.mark.parametrize("width, seed_words, hot", [(6, 3, 2000), (12, 4, 1), (5, 5, 2000)])
def test_equals_brute_force(documents, spark, rows, width, seed_words, hot):
    made = rows(*texts(width))
    out = substrings.remove_repeats(documents(made), Stage(spark), width, seed_words, hot)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in out.collect()}
    assert got == brute([(r[0], r[1]) for r in made], width)


def test_text_shrinks_and_columns_stay(documents, rows, stage):
    made = rows("a b c d e", "z a b c d e y", "a b c")
    out = {r.doc_id: r for r in substrings.remove_repeats(documents(made), stage, 4, 2).collect()}
    assert [out[i].text for i in (1, 2, 3)] == ["a b c d e", "z y", "a b c"]
    assert out[2].score == "x" and out[2].lang == "en"


def test_rows_without_id_and_repeated_rows(documents, rows, stage):
    made = [*rows("a b c d", "a b c d"), (None, "a b c d", *[None] * 6)]
    out = substrings.remove_repeats(documents([*made, made[1]]), stage, 3, 2).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in out) == [(0, 0), (1, 0), (2, 4), (2, 4)]


def test_empty_table(documents, stage):
    assert substrings.remove_repeats(documents([], 1), stage, 3, 2).count() == 0


def test_different_texts_under_one_key_are_told_apart(monkeypatch):
    """Should two windows share a key, they are compared as text."""
    real = substrings._window_keys

    def colliding(packed, width):
        found, at, high, low = real(packed, width)
        return found, at, np.zeros_like(high), np.zeros_like(low)

    monkeypatch.setattr(substrings, "_window_keys", colliding)
    least, counts = substrings.first_documents([b"a b c", b"b c d", b"a b"], np.array([5, 3, 9]), 2)
    assert least.tolist() == [5, 3, 3, 3, 5] and counts.tolist() == [2, 2, 1]
