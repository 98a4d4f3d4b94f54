"""Classifiers by held-out accuracy, the tagger's marginals by enumeration, neighbours by brute force."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest

from tiffin.llm import ann, quality_ranker, toxicity

GOOD = "The river runs past the old mill and the town, where people meet. On some days it rains."


def labelled(spark, texts, labels):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, label int")


def noisy(rng, text):
    kind = rng.randrange(3)
    words = text.split()
    if kind == 0:
        return " ".join(w + rng.choice(["$$$", "%%%", "###"]) for w in words)
    if kind == 1:
        return " ".join(w.upper() + "!!" for w in words)
    return " ".join(f"{w} {w} {w} {w}" for w in words)


def prose(rng):
    words = GOOD.split()
    rng.shuffle(words)
    return " ".join(words * rng.randint(1, 4))


def test_quality_is_learned(spark):
    rng = random.Random(1)
    labels = [rng.randrange(2) for _ in range(240)]
    texts = [prose(rng) if good else noisy(rng, prose(rng)) for good in labels]
    docs, known = labelled(spark, texts, labels)
    ranker = quality_ranker.train(docs, known.filter("doc_id < 160").unionByName(
        spark.createDataFrame([(9999, 1), (None, 0), (3, None)], "doc_id long, label int")))
    scores = {r.doc_id: r.score for r in quality_ranker.score(docs, ranker).collect()}
    held = range(160, 240)
    assert sum((scores[i] >= 0.3) == labels[i] for i in held) >= 76
    assert all(0 <= s <= 1 for s in scores.values())


def test_quality_edges(spark, documents, rows):
    made = rows("", None, "x", "long " * 20_000, "x")
    table = documents([*made, (None, "x", *[None] * 6)])
    ranker = quality_ranker.train(table, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    out = quality_ranker.score(table, ranker).collect()
    assert len(out) == 6 and all(r.score == 1 for r in out) and "shard" in out[0]
    both = quality_ranker.train(table, spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, label int"))
    scores = [(r.text, r.score) for r in quality_ranker.score(table, both).collect()]
    assert len({s for t, s in scores if t == "x"}) == 1 and len({s for t, s in scores if not t}) == 1
    assert quality_ranker.score(documents([], 1), both).count() == 0


def test_features_do_not_depend_on_the_chunk():
    texts = [b"One two  two.\n", b"", b"A!", "é ü 12".encode(), b"w " * 300]
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    together = quality_ranker.features(np.frombuffer(b"".join(texts), dtype=np.uint8), offsets)
    for i, text in enumerate(texts):
        alone = quality_ranker.features(np.frombuffer(text, dtype=np.uint8), np.array([0, len(text)]))
        assert np.allclose(alone[0], together[i])


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    emission, first = rng.normal(0, 2, 9), np.zeros(9, dtype=bool)
    first[[0, 4, 5]] = True
    transition = rng.normal(0, 1, (2, 2))
    weight = np.zeros(9)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=9):
        score = sum(e for e, y in zip(emission, labels) if y) + sum(
            transition[labels[t - 1], labels[t]] for t in range(1, 9) if not first[t])
        total += np.exp(score)
        weight += np.exp(score) * np.array(labels)
    _, forward, backward = toxicity.ratios(emission, first, transition)
    assert np.allclose(forward * backward / (1 + forward * backward), weight / total)


def test_long_chains_equal_one_step_at_a_time():
    rng = np.random.default_rng(3)
    m = [rng.uniform(0.1, 2, 5000) for _ in range(4)]
    value, expected = 0.5, []
    for a, b, c, d in zip(*m):
        value = (a * value + b) / (c * value + d)
        expected.append(value)
    assert np.allclose(toxicity._scan(m, 0.5), expected)


def test_toxic_words_are_learned_and_placed(spark):
    rng = random.Random(4)
    insults = ["blimpo", "zarkast", "grotwig"]
    labels = [int(rng.random() < 0.4) for _ in range(300)]
    texts = []
    for toxic in labels:
        words = [f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('lmnr')}" for _ in range(40)]
        if toxic:
            words[rng.randrange(40)] = rng.choice(insults)
        texts.append("Über " + " ".join(words))
    docs, known = labelled(spark, texts, labels)
    tagger = toxicity.train(docs, known.filter("doc_id < 200"))
    out = {r.doc_id: r for r in toxicity.tag(docs, tagger).collect()}
    held = range(200, 300)
    assert sum((out[i].score >= 0.5) == labels[i] for i in held) >= 97
    spans = [out[i].text[s.start:s.end] for i in held for s in out[i].spans]
    assert spans and sum(s in insults for s in spans) >= 0.95 * len(spans)


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.append(0, np.cumsum([len(r) for r in raw]))


def taught(texts, toxic):
    out = []
    for i, text in enumerate(texts):
        found, tokens = toxicity.token_features(*flat([text]))
        if len(found.starts):
            family = toxicity._smallest_run(found.hashes(), found.first, np.array([0]))
            out.append(toxicity.Taught(toxic, int(family.view(np.int64)[0]), tokens))
    return out


def plain_telling(toxic, clean):
    """Words and beginnings by their text, counted once per group of texts that share their least run of four words."""
    def parts(text):
        found = [w.lower() for w in re.findall(r"[A-Za-z\x80-\U0010ffff]+", text)]
        return {kind: {w.encode()[:n] if n else w.encode() for w in found} for kind, n in enumerate((0, 4, 5))}

    counts, families = [], []
    for texts, bad in ((toxic, True), (clean, False)):
        own = {}
        for text, doc in zip([t for t in texts if re.search(r"[A-Za-z\x80-\U0010ffff]", t)], taught(texts, bad), strict=True):
            group = own.setdefault(doc.family, {0: set(), 1: set(), 2: set()})
            for kind, some in parts(text).items():
                group[kind] |= some
        count = collections.Counter((kind, x) for group in own.values() for kind, some in group.items() for x in some)
        counts.append(count)
        families.append(len(own))
    share = max(families[0], 1) / max(sum(families), 2)
    tried = sum(n >= 2 for n in counts[0].values())
    least = max(3, math.ceil(math.log(max(tried, 2)) / -math.log(share)))
    return {x for x, n in counts[0].items() if n >= least and counts[1][x] <= 0.02 * n}


def test_telling_features_equal_counting_texts():
    rng = random.Random(9)
    plain = ["".join(x) for x in itertools.product("bcdfgk", "aeiou", "lrst")]
    toxic, clean = [], []
    for i in range(260):
        words = [rng.choice(plain) + rng.choice(["", "mun", "tor"]) for _ in range(rng.randrange(3, 15))]
        (toxic if i % 3 == 0 else clean).append(" ".join(words + [rng.choice(["Blimpo", "blimpert", "zarkast"])] * (i % 3 == 0)))
    toxic += [toxic[0]] * 20 + ["", "12 !!"]
    found = set(toxicity.telling_features([*taught(toxic, True), *taught(clean, False)]).tolist())
    expected = set()
    for kind, text in plain_telling(toxic, clean):
        _, tokens = toxicity.token_features(*flat([text.decode()]))
        expected.add(int(tokens[kind, 0]))
    assert expected and found == expected


def test_portions_teach_like_one(monkeypatch):
    rng = random.Random(10)
    texts = [" ".join(rng.choice(["lo", "ma", "ne", "po", "ru"]) + rng.choice("xyz") for _ in range(9)) for _ in range(80)]
    docs = [*taught([t + " blimpo" for t in texts[:30]], True), *taught(texts[30:], False)]
    one = toxicity.fit(docs, rounds=8)
    monkeypatch.setattr(toxicity, "FIT_TOKENS", 50)
    many = toxicity.fit(docs, rounds=8)
    assert np.array_equal(one.features, many.features) and np.allclose(one.weights, many.weights, atol=1e-5)
    assert np.allclose(one.transition, many.transition) and abs(one.bias - many.bias) < 1e-6


def test_what_teaches_is_bounded(spark):
    docs = spark.createDataFrame([(i, "some plain words " * (1 + i % 3) + ("blimpo" if i % 2 else "")) for i in range(60)] * 3 + [
        (1, "another text of the first")] * 500, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, label int")
    chosen = quality_ranker.sampled(docs, labels, {0: 10, 1: 10}).collect()
    assert len(chosen) == 20 == len({r.doc_id for r in chosen})
    assert toxicity.numbered(quality_ranker.sampled(docs, labels, {0: 10, 1: 10})).count() == 20
    assert toxicity.train(docs, labels, most_bytes=10).features.size == 0


def plain_quality_features(text):
    """The features of one text, byte by byte and word by word."""
    data = text.encode()
    size, some = len(data), max(len(data), 1)
    kind = quality_ranker._KIND
    out = np.zeros(quality_ranker.BINS)
    for a, b in zip(data, data[1:]):
        out[quality_ranker._PAIR_BIN[kind[a] * 64 + kind[b]]] += 1
    words = data.split()
    lengths = [len(w) for w in words]
    several = max(len(words), 1)
    mean = sum(lengths) / several
    spread = max(sum(n * n for n in lengths) / several - mean ** 2, 0) ** 0.5
    again = sum(a == b for a, b in zip(words, words[1:]))
    different = len(set(words))
    share = lambda low, high: sum(low <= kind[b] <= high for b in data) / some
    lines = sum(kind[b] == 6 for b in data) + 1
    return [*np.sqrt(out / some), math.log1p(size) / 10, math.log1p(len(words)) / 10, mean / 10, spread / 10, different / several,
            4 * again / several, math.log1p(len(words) / lines) / 5, math.log1p(len(words) / max(different, 1)),
            2 * share(2, 2), 2 * share(3, 3), 4 * share(7, 63), float(size == 0)]


def test_quality_features_equal_counting():
    texts = ["One two  two.\n", "", "A!", "é ü 12 日本", "w " * 300, "A-Z, a.z; 0-9\n\n\tx"]
    found = quality_ranker.features(*flat(texts))
    for text, row in zip(texts, found, strict=True):
        assert np.allclose(row, plain_quality_features(text))


def test_preferences_are_at_their_best():
    """Along every direction the penalised likelihood falls: compared with plain gradient ascent."""
    rng = np.random.default_rng(8)
    differences = rng.normal(0.4, 1, (300, 5))
    weights, decay = quality_ranker.fit_preferences(differences, decay=1e-2), 1e-2
    plain = np.zeros(5)
    for _ in range(20_000):
        plain += 0.5 * (differences.T @ (1 - 1 / (1 + np.exp(-differences @ plain))) / len(differences) - decay * plain)
    assert np.allclose(weights, plain, atol=1e-4)


def test_the_threshold_is_a_quantile_of_labelled_scores():
    rng = np.random.default_rng(9)
    bad, good = rng.normal(0, 1, 40), rng.normal(2, 1, 160)
    for share, strictness in ((0.2, 1.0), (0.2, 0.99), (0.5, 0.9)):
        ranker = quality_ranker._calibrated(np.ones(1), bad, good, share, strictness)
        weighed = sorted([(s, share / 40) for s in bad] + [(s, (1 - share) / 160) for s in good])
        total, at = 0.0, 0
        while total + weighed[at][1] < strictness * share - 1e-12:
            total += weighed[at][1]
            at += 1
        assert abs(ranker.threshold - (weighed[at][0] + weighed[at + 1][0]) / 2) < 1e-9
        assert abs(ranker.score(np.array([[ranker.threshold]]))[0] - 0.3) < 1e-9


def test_every_clean_document_of_the_sample_teaches():
    other = ["".join(x) for x in itertools.product("bcdfgk", "aeiou", "lr")]
    toxic = [f"plain blimpo words {other[i]}" for i in range(10)]
    clean = [f"plain words {x}" for x in other[10:50]] + [f"plain words and rompo {x}" for x in other[50:]]
    tagger = toxicity.fit([*taught(toxic, True), *taught(clean, False)])
    _, tokens = toxicity.token_features(*flat(["blimpo rompo"]))
    weights = tagger.table()[tokens]
    assert weights[0, 0] > 0 > weights[0, 1]


def test_toxicity_edges(spark, documents, rows):
    table = documents([*rows("", None, "x", "12 !!", "long " * 20_000), (None, "x", *[None] * 6)])
    tagger = toxicity.train(table, spark.createDataFrame([(1, 1)], "doc_id long, label int"))
    out = toxicity.tag(table, tagger).collect()
    assert len(out) == 6 and all(r.score < 0.01 and r.spans == [] for r in out)
    assert toxicity.tag(documents([], 1), tagger).count() == 0


def brute(vectors, k):
    out = {}
    usable = [(i, np.array(v, dtype=float)) for i, v in vectors if i is not None and v is not None and None not in v
              and np.isfinite(v).all() and np.any(v) and len(v) == 8]
    for q, x in usable:
        ranked = sorted((-float(v @ x), i) for i, v in usable if i != q)
        out[q] = [i for _, i in ranked[:k]]
    return out


def test_few_vectors_are_all_found(spark, stage):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(12)]
    rows += [(20, None), (21, [0.0] * 8), (22, [None] + [1.0] * 7), (23, [float("nan")] * 8), (24, [float("inf")] * 8),
             (25, [1.0, 2.0]), (None, [1.0] * 8), (30, rows[1][1]), (31, rows[1][1]), rows[2]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    out = ann.search(frame, frame, stage, 20, shard_rows=4)
    got = {}
    for r in out.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == brute(rows[:-1], 20)
    assert ann.search(frame.limit(0), frame, stage).count() == 0


@pytest.mark.parametrize("shard_rows", [8192, 300])
def test_recall(spark, stage, shard_rows):
    rng = np.random.default_rng(6)
    data = rng.standard_normal((1500, 32))
    data /= np.linalg.norm(data, axis=1)[:, None]
    data[100:500] = data[100]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    out = ann.search(frame, frame.filter("vec_id % 50 = 0"), stage, 20, shard_rows=shard_rows).collect()
    hit = 0
    for q in range(0, 1500, 50):
        scores = data @ data[q]
        true = [i for i in np.lexsort((np.arange(1500), -scores.round(12))) if i != q][:20]
        mine = [r.vec_id for r in sorted(out, key=lambda r: r.rank) if r.query_id == q]
        assert len(mine) == 20
        hit += len(set(true) & set(mine))
    assert hit >= 0.9 * 20 * 30


def test_every_labelled_row_teaches_preferences(spark, monkeypatch):
    """Rows of all groups: the fit and the threshold equal those of all pairs and scores taken together."""
    for name, value in (("GROUP_ROWS", 40), ("LEAST_OTHER", 5), ("RANGES", 3), ("FEW_SCORES", 4)):
        monkeypatch.setattr(quality_ranker, name, value)
    rng = random.Random(4)
    labels = [int(rng.random() < 0.9) for _ in range(300)]
    texts = [prose(rng) + f" {i}" if good or i % 2 else noisy(rng, prose(rng)) for i, good in enumerate(labels)]
    docs, known = labelled(spark, texts, labels)
    counts = {label: labels.count(label) for label in (0, 1)}
    groups = [(r.place, *(quality_ranker._rows(b) for b in (r.bad, r.good)))
              for r in quality_ranker._dealt(docs, known, counts, 7).collect()]
    assert len(groups) > 3 and sum(len(good) for *_, good in groups) == counts[1]
    features = quality_ranker.features(*flat(texts)).astype(np.float32).astype(float)
    bad, good = (features[[x == label for x in labels]] for label in (0, 1))
    assert {r.tobytes() for _, part, _ in groups for r in part} == {r.tobytes() for r in bad}
    assert {r.tobytes() for *_, part in groups for r in part} == {r.tobytes() for r in good}
    weights = quality_ranker.fit_preferences(np.concatenate([
        quality_ranker._pairs(b, g, quality_ranker.PAIRS, 7 + place) for place, b, g in groups if len(b) and len(g)]))
    ranker = quality_ranker.train(docs, known)
    assert np.allclose(ranker.weights, weights, atol=1e-5)
    plain = quality_ranker._calibrated(np.array(ranker.weights), bad @ ranker.weights, good @ ranker.weights, counts[0] / 300, 0.99)
    assert abs(ranker.threshold - plain.threshold) < 1e-6
