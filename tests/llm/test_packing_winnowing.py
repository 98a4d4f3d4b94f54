import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tiffin.llm import packing, winnowing

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n\t", "It's we'll THE end. don't", "a,b.c!! 12 3", "<|endoftext|> x<|startoftext|>y", "é ́x é İ Σας ΣΑΣ",
       "tab\x0bvt\x0cff nb sp  em \x1cfs", "word " * 9000, "x" * 5000, "日本語 テキスト 👩‍👩‍👧", "the end. don't"]


def plain_first_fit(sizes, capacity):
    bins, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = next((b for b, room in enumerate(bins) if room >= sizes[i]), len(bins))
        if at == len(bins):
            bins.append(capacity)
        out[i] = (at, capacity - bins[at])
        bins[at] -= sizes[i]
    return [out[i] for i in range(len(sizes))]


def test_tournament_tree_equals_first_fit():
    rng = random.Random(1)
    for n in (1, 2, 3, 17, 200):
        sizes = np.array([rng.choice([1, 5, 40, 64, rng.randint(1, 63)]) for _ in range(n)])
        bins, places = packing.first_fit_decreasing(sizes, 64)
        assert list(zip(bins.tolist(), places.tolist())) == plain_first_fit(sizes.tolist(), 64)


def test_remembered_ids_equal_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    plain = Tokenizer.from_file(TOKENIZER)
    for text, ids in zip(ODD, packing.Encoder(TOKENIZER).encode(ODD), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_plain_letters_and_marks_equal_whole_texts():
    letters = [chr(c) for c in range(0x180) if chr(c).isalpha()]
    marks = [chr(c) for c in range(33, 127) if not chr(c).isalnum()]
    rng = random.Random(2)
    texts = [*(form.format(c) for c in letters for form in ("{0}", "x{0}{0}Y", "{0}!!", "{0}'s", "{0}\u0301", "\u0301{0}")),
             *(f"Ab{a}{b} {a}{b}" for a in marks for b in marks),
             *("".join(rng.choice([*letters, *marks, *" \n\t12\u0308\u0338日"]) for _ in range(rng.randint(1, 40))) for _ in range(3000))]
    plain = Tokenizer.from_file(TOKENIZER)
    for text, ids in zip(texts, packing.Encoder(TOKENIZER).encode(texts), strict=True):
        assert np.frombuffer(ids, dtype="<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_a_word_is_learned_once_in_any_case_and_with_any_marks():
    encoder = packing.Encoder(TOKENIZER)
    list(encoder.encode(["Word word, WORD!! word... wOrd", "ÉTÉ Été, été!!"]))
    assert len(encoder._ids) == 6  # nothing, two words, three runs of marks


def test_ids_do_not_depend_on_texts_taken_together(monkeypatch):
    texts = ["", "one two", None, "two ", " three", "", "x" * 50, "one", None]
    monkeypatch.setattr(packing, "TOGETHER", 9)
    apart = list(packing.Encoder(TOKENIZER, 2).encode(texts))
    monkeypatch.undo()
    assert apart == list(packing.Encoder(TOKENIZER).encode(texts))
    assert list(packing.Encoder(TOKENIZER).encode([])) == [] and list(packing.Encoder(TOKENIZER).encode([None, " \n"])) == [b"", b""]


@pytest.mark.parametrize("group_items", [50_000, 5])
def test_pieces_and_sequences(documents, rows, stage, group_items):
    made = rows(*ODD, *["some words here " * k for k in range(60)])
    table = documents([*made, made[3], (None, "x", *[None] * 6)])
    out = packing.pack(packing.pieces(table, TOKENIZER, 256, keep_ids=True), stage, 256, group_items=group_items).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        parts[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc, text, *_ in made:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes()
        found = sorted(parts[doc], key=lambda r: r.start)
        copies = 2 if doc == made[3][0] else 1
        assert b"".join(bytes(r.ids) for r in found[::copies]) == ids
        assert {r.doc_tokens for r in found} == {len(ids) // 4}
    for some in sequences.values():
        some.sort(key=lambda r: r.offset)
        assert [r.offset for r in some] == np.cumsum([0, *[r.length for r in some]])[:-1].tolist()
        assert sum(r.length for r in some) <= 256
    assert len(parts[None]) == 1


def test_packing_an_empty_table(documents, stage):
    assert packing.pack(packing.pieces(documents([], 1), TOKENIZER), stage).count() == 0


def plain_winnow(text, k, window):
    """Smallest hash of each window, rightmost of equal ones, by the operator's own hashes."""
    points = winnowing.code_points(text)
    if not len(points):
        return []
    k = min(k, len(points))
    hashes = [int(winnowing.winnow(points[i:i + k], k, 1)[0][0]) for i in range(len(points) - k + 1)]
    chosen = set()
    for i in range(max(len(hashes) - window + 1, 1)):
        some = list(enumerate(hashes[i:i + window], i))
        chosen.add(max(some, key=lambda x: (-x[1], x[0])))
    return sorted((p, h) for p, h in chosen)


@pytest.mark.parametrize("text", ["", "a", "abcde", "aaaaaaaaaaaaaaaaaaaaaaaa", "abcabcabcabcabcabcabc", "é👩日" * 9, "the quick brown fox " * 4])
def test_winnowing_equals_plain(text):
    hashes, places = winnowing.winnow(winnowing.code_points(text), 4, 5)
    assert list(zip(places.tolist(), hashes.tolist())) == plain_winnow(text, 4, 5)


def test_shared_passages_are_found():
    rng = random.Random(5)
    for _ in range(50):
        passage = "".join(rng.choice("abcdefgh ") for _ in range(8 + 6 - 1))
        a, b = ("".join(rng.choice("ijklmnop") for _ in range(rng.randint(0, 40))) + passage +
                "".join(rng.choice("qrstuvw") for _ in range(rng.randint(0, 40))) for _ in range(2))
        one, other = (set(winnowing.winnow(winnowing.code_points(t), 6, 8)[0].tolist()) for t in (a, b))
        assert one & other


@pytest.mark.parametrize("ranges", [1, 4, None])
def test_edited_texts(documents, rows, ranges):
    rng = random.Random(3)
    made = rows("", None, "é", "ab", "same text here", "same text here", *["".join(rng.choice("abc é👩") for _ in range(rng.randint(0, 200)))
                                                                       for _ in range(40)], "long " * 4000)
    made += [made[10], (None, "no id", *[None] * 6), (-5, "below", *[None] * 6)]
    out = sorted(((r.doc_id if r.doc_id is not None else -99, r.n_chars, r.edited_sha256) for r in
                  winnowing.edited_fingerprints(documents(made), ranges=ranges).collect()))
    line = sorted(((m[0] if m[0] is not None else -99, m[1] or "") for m in made), key=lambda m: (-m[0], m[1]))
    expected = []
    for (doc, text), (_, following) in zip(line, [*line[1:], line[0]]):
        half = len(text) // 2
        edited = text[:len(text) - half] + following[:half]
        expected.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    assert out == sorted(expected)


def test_fingerprints(documents, rows):
    made = rows("same text here and there and everywhere", "same text here and there and everywhere", "", None)
    out = {r.doc_id: r for r in winnowing.edited_fingerprints(documents(made)).collect()}
    assert out[1].fingerprint == out[2].fingerprint != "" and out[2].near_next == 1.0
    assert out[3].fingerprint == "" and out[4].near_next == 1.0 and out[3].near_next == 0.0
    listed = {r.doc_id: r for r in winnowing.fingerprints(documents(made)).collect()}
    assert listed[1].fingerprint == out[1].fingerprint and len(listed[1].positions) == len(listed[1].hashes)
    assert winnowing.edited_fingerprints(documents([], 1)).count() == 0


def test_short_texts_stay_alike_after_the_edit(documents, rows):
    rng = random.Random(8)
    made = rows(*["".join(rng.choice("abcdefgh é👩") for _ in range(n)) for n in range(30, 161)])
    out = winnowing.edited_fingerprints(documents(made)).collect()
    assert len(out) == 131 and all(0 < r.near_edited <= 1 for r in out)


def test_long_batches_are_sent_in_parts(documents, rows, monkeypatch):
    monkeypatch.setattr(winnowing, "SENT", 50)
    made = rows(*[f"text {i} of some length" for i in range(40)], "", None)
    out = winnowing.edited_fingerprints(documents(made)).collect()
    assert sorted(r.doc_id for r in out) == list(range(1, 43))
