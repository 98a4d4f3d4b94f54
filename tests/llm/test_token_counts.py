import random

import public_tokenizers
import sentencepiece
from tokenizers import models

from tiffin.llm import token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_a_unigram_tokenizer():
    rng = random.Random(1)
    pieces = [("▁", -5.0), ("▁a", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("▁▁", -4.0), ("bb", -1.5)]
    plain = models.Unigram([("<unk>", 0.0), *pieces, *[(f"<0x{b:02X}>", -100.0) for b in range(256)]], 0, True)
    mine = token_counts.Counter(pieces)
    mine._unknown = -110.0
    for _ in range(400):
        text = "".join(rng.choice("aabb  cé日") for _ in range(rng.randint(1, 14)))
        assert mine.count(text) == len(plain.tokenize("▁" + text.replace(" ", "▁"))), text


def test_rows(documents, rows):
    made = rows("", None, "a", "the same", "the same", "日本 👩", "word " * 20_000, "\n\t")
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents([*made, made[3]]), PATH).collect()}
    assert out[1] == out[2] == 0 and out[4] == out[5] > 0 and out[7] >= 20_000
    assert token_counts.token_counts(documents([], 1), PATH).count() == 0


def whole_texts():
    rng = random.Random(2)
    words = ["".join(rng.choice("aeiou" if i % 2 else "bdklmnrst") for i in range(rng.randint(1, 9))) for _ in range(400)]
    return [rng.choice(["", "   ", "\n"]).join(rng.choice([w, w + ",", w.title()]) + rng.choice([" ", " ", "  ", "\n", "\t"])
                                               for w in rng.choices(words, k=rng.randint(1, 600))) + rng.choice(["", "é日👩", " "])
            for _ in range(150)]


def test_whole_texts_equal_the_fitted_models_encode(documents, rows):
    texts = whole_texts()
    model = token_counts.fit_unigram(texts[:100], 2000)
    plain = sentencepiece.SentencePieceProcessor(model_proto=model)
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(rows(*texts, "", None)), model).collect()}
    assert out == dict(enumerate([*(len(plain.encode(t)) for t in texts), 0, 0], 1))


def test_a_file_counts_by_its_own_encode(documents, rows):
    texts = [*whole_texts()[:30], "frequent words     and   runs of spaces"]
    plain = sentencepiece.SentencePieceProcessor(model_file=PATH)
    out = {r.doc_id: r.n_tokens for r in token_counts.token_counts(documents(rows(*texts)), PATH).collect()}
    assert out == dict(enumerate([len(plain.encode(t)) for t in texts], 1))


def test_the_sample_is_bounded_and_counts_copies_once(documents, rows):
    made = rows(*["copy"] * 50, *[f"text {i} " * 40 for i in range(30)], "", None)
    some = token_counts.sample_texts(documents(made), 20, 100)
    assert len(some) == 20 and some.count("copy") <= 1 and max(map(len, some)) <= 100
    assert token_counts.sample_texts(documents(made, 5), 20, 100) == some
    assert len(token_counts.sample_texts(documents(made), 100)) == 31
    assert token_counts.sample_texts(documents([], 1)) == [] and token_counts.fit_unigram([])
