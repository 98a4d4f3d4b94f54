import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from tiffin.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = ["", None, " ", " \n\t  x", "It's we'll THE end. don't", "x" * 5000, "ab" * 700 + " " * 300 + "\n" * 77, "word " * 70_000,
       "é ́x İ Σας \x1cfs nb sp  em \u0085", "日本語 テキスト 👩‍👩‍👧 " * 40, "<|endoftext|> 12345 0.5%", "It's we'll THE end. don't"]


@pytest.fixture(scope="module")
def vocabulary():
    return byte_bpe.Vocabulary.load(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain():
    with open(PATH, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_every_token_has_its_own_slot(vocabulary):
    slots = vocabulary.perfect.slots(vocabulary.tokens)
    assert slots.tolist() == list(range(len(vocabulary.tokens)))
    assert byte_bpe.PerfectHash.build([]).slots([b"x"]).tolist() == [0]
    for size in (1, 2, 3, 50):
        keys = [f"key {i}".encode() for i in range(size)]
        made = byte_bpe.PerfectHash.build(keys)
        assert sorted(made.slots(keys).tolist()) == list(range(size))
        assert (made.slots([b"other", b""]) < size).all()


def test_ids_equal_the_library(vocabulary, plain, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD800), rng.randrange(0xE000, 0x11000)]))
                     for _ in range(rng.randrange(60))) for _ in range(400)]
    for remembered, step in ((300_000, 50_000), (5, 7)):
        monkeypatch.setattr(byte_bpe, "REMEMBERED", remembered)
        monkeypatch.setattr(byte_bpe, "STEP", step)
        encoder = byte_bpe.Encoder(vocabulary)
        for text in [*(t or "" for t in ODD), *texts][::1 if step > 7 else 5]:
            assert encoder.encode(text).tolist() == plain.encode_ordinary(text)


def test_rows(spark, vocabulary, plain, documents, rows):
    made = [*rows(*ODD), (None, "x", *[None] * 6)]
    table = documents([*made, made[4]]).withColumnRenamed("shard", "ids").withColumnRenamed("size", "decoded")
    out = byte_bpe.decode(byte_bpe.encode(table, vocabulary), vocabulary)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "score", "ids", "decoded"]
    found = out.collect()
    assert len(found) == len(made) + 1
    for r in found:
        assert r.ids == plain.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    assert byte_bpe.encode(table.limit(0), vocabulary).count() == 0


def test_ids_of_no_text(spark, vocabulary):
    table = spark.createDataFrame([([1, 2],), ([60_000],), ([1, None],), (None,), ([],)], "ids array<int>")
    out = [r.decoded and bytes(r.decoded) for r in byte_bpe.decode(table, vocabulary, ["ids"]).collect()]
    token = vocabulary.by_id()
    assert out == [token[1] + token[2], None, None, b"", b""]


def test_query_equals_the_library(spark, plain):
    from tiffin.llm import queries
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op11_byte_bpe"](spark, sf).collect():
        ids = plain.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_stretches_between_spaces_are_encoded_once_a_worker(vocabulary, plain, monkeypatch):
    """Texts cut at spaces give the library's ids, and a second task of the worker joins nothing again."""
    rng = random.Random(5)
    parts = ["blimpoq", "it's", "'s", "zzqy,", "¿qué?", "\x1cq", "12ab", "x" * 60]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", " ", " ", "  ", "\n", " \n ", "\t", "\n\n ", " "])
                     for _ in range(rng.randrange(12))) for _ in range(300)]
    texts += [" " + t for t in texts[:50]]
    calls = []
    real = byte_bpe.joined_by_rank
    monkeypatch.setattr(byte_bpe, "joined_by_rank", lambda piece, ranks: calls.append(piece) or real(piece, ranks))
    for _ in range(2):  # as two tasks of one worker
        found = byte_bpe._worker_encoder(vocabulary).encode_all(texts)
        assert [f.tolist() for f in found] == [plain.encode_ordinary(t) for t in texts]
        short = [c for c in calls if len(c.decode()) <= byte_bpe.SHORT]
        assert len(short) == len(set(short)) > 0
    other = byte_bpe.Vocabulary.build({bytes([b]): b for b in range(256)}, r"\w \w|.")
    assert byte_bpe.Encoder(other).encode("a b c").tolist() == list(b"a b c")


def test_new_stretches_of_a_chunk_are_matched_and_joined_together(vocabulary, plain, monkeypatch):
    """One match for all new stretches that follow a space; heaps of short pre-tokens are begun as arrays."""
    class Counted:
        def __init__(self, pattern):
            self.pattern, self.matched = pattern, 0

        def findall(self, text):
            self.matched += 1
            return self.pattern.findall(text)

    rng = random.Random(9)
    words = ["".join(rng.choice("abehinorstéß日.,'\x1c") for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    texts = ["".join(w + rng.choice([" ", " ", "  ", "\n", " \n"]) for w in words[at:at + 300]) for at in range(0, 3000, 300)]
    one_by_one = []
    real = byte_bpe.joined_by_rank
    monkeypatch.setattr(byte_bpe, "joined_by_rank", lambda piece, ranks: one_by_one.append(piece) or real(piece, ranks))
    encoder = byte_bpe.Encoder(vocabulary)
    encoder._pieces = Counted(encoder._pieces)
    assert [f.tolist() for f in encoder.encode_all(texts)] == [plain.encode_ordinary(t) for t in texts]
    assert encoder._pieces.matched <= len(texts) + 1
    assert all(len(p) > byte_bpe.TOGETHER for p in one_by_one)


def test_joined_together_equals_one_by_one():
    """Overlapping pairs, ranks that do not follow length, and bytes without a rank."""
    rng = random.Random(11)
    ranks = {bytes([b]): b for b in range(256)} | {b"aa": 300, b"aaa": 256, b"ab": 257, b"ba": 258, b"aba": 299}
    pieces = [bytes(rng.choice(b"aab") for _ in range(rng.randrange(90))) for _ in range(byte_bpe.BATCH + 500)]
    assert byte_bpe.Joiner(ranks).joined(pieces) == [byte_bpe.joined_by_rank(p, ranks) for p in pieces]
    assert byte_bpe.Joiner({b"a": 0, b"ab": 1}).joined([b"aab"] * 100) == [[0, 1]] * 100
    with pytest.raises(KeyError):
        byte_bpe.Joiner({b"a": 0, b"ab": 1}).joined([b"ba"] * 100)
