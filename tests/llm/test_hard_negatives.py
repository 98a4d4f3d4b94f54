import math
import random

import numpy as np
import pytest

from tiffin.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>, score string, rank string"


def plain(rows, anchors, positives=5, k=10):
    def clean(some):
        out = set()
        for i, label, vec, *_ in some:
            if None in (i, label, vec) or not vec or any(x is None or not math.isfinite(x) for x in vec):
                continue
            out.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in vec)))
        return out

    rows, anchors = clean(rows), clean(anchors)
    counts = {}
    for _, _, v in rows:
        counts[len(v)] = counts.get(len(v), 0) + 1
    if not counts:
        return []
    size = min(counts, key=lambda n: (-counts[n], n))
    rows, anchors = ([r for r in some if len(r[2]) == size] for some in (rows, anchors))
    out = []
    for i, label, vec in anchors:
        scored = sorted((-sum(a * b for a, b in zip(vec, v)), j, other) for j, other, v in rows if j != i)
        near = [(j, -s) for s, j, other in scored if other == label][:positives]
        for p, ps in near:
            found = [(j, -s) for s, j, other in scored if other != label and 30 * ps <= -100 * s <= 90 * ps][:k]
            out += [(i, p, rank, j, ps, s) for rank, (j, s) in enumerate(found, 1)]
    return sorted(out)


def table(seed, n=260, size=9):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(5)]
    rows = []
    for i in range(n):
        vec = [c + rng.gauss(0, 0.7) for c in centres[i % 5]]
        rows.append((i, rng.randrange(4) if i % 3 else 1, vec, "x", "y"))
    rows += [(1000 + i, i % 2, rows[0][2], "x", "y") for i in range(90)]  # one frequent vector
    rows += rows[:20]
    rows += [(7, 1, rows[3][2], "a", "b"), (None, 1, rows[0][2], "", ""), (500, None, rows[0][2], "", ""), (501, 1, None, "", ""),
             (502, 1, [float("nan")] * size, "", ""), (503, 1, [float("inf")] * size, "", ""), (504, 1, [None] * size, "", ""),
             (505, 1, [1.0] * (size - 1), "", ""), (506, 1, [], "", ""), (507, 2, [0.0] * size, "", ""), (-20, 2, rows[1][2], "", "")]
    return rows


@pytest.mark.parametrize("bits, shard_rows", [(64, 1000), (192, 37)])
def test_equals_scoring_everything(spark, stage, bits, shard_rows):
    rows = table(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    asked = [r for r in rows if r[0] is not None and r[0] % 10 == 0]
    out = hard_negatives.mine(df, df.filter("vec_id % 10 = 0"), stage, bits=bits, shard_rows=shard_rows)
    assert sorted(map(tuple, out.collect())) == plain(rows, asked)


def test_intervals_hold_every_score():
    rng = np.random.default_rng(4)
    for size, bits in ((3, 64), (64, 64), (64, 512)):
        frame = hard_negatives.Frame(size, bits)
        rotation = frame.rotation()
        vectors = rng.integers(-200, 200, (400, size))
        vectors[:3] = np.array([[0], [1], [-(1 << 24)]])
        code, align, rest, factor = frame.encode(vectors, rotation)
        words = np.frombuffer(code.tobytes(), dtype=np.uint64).reshape(-1, bits // 64).T.copy()
        shard = hard_negatives.Shard(np.arange(400), np.zeros(400), vectors, words, align, rest, factor)
        for question in vectors[:40]:
            low, high = shard.bounds(question, rotation @ question)
            exact = vectors @ question
            assert (low <= exact).all() and (exact <= high).all()


def test_more_bits_leave_fewer_to_score():
    rng = np.random.default_rng(5)
    vectors = rng.integers(-60, 60, (4000, 64))
    widths = []
    for bits in (64, 256, 1024):
        frame = hard_negatives.Frame(64, bits)
        code, align, rest, factor = frame.encode(vectors, frame.rotation())
        words = np.frombuffer(code.tobytes(), dtype=np.uint64).reshape(-1, bits // 64).T.copy()
        shard = hard_negatives.Shard(np.arange(4000), np.zeros(4000), vectors, words, align, rest, factor)
        scores = hard_negatives.Scores(shard, vectors[0], frame.rotation() @ vectors[0])
        scores.best(np.arange(4000) > 0, 10)
        widths.append(int(scores.known.sum()))
    assert widths[2] < widths[1] < widths[0] and widths[2] < 2000


def test_empty(spark, stage):
    empty = spark.createDataFrame([], SCHEMA)
    assert hard_negatives.mine(empty, empty, stage).count() == 0
    only = spark.createDataFrame([(0, 1, [1.0, 2.0], "", ""), (5, 2, [1.0, 2.0], "", "")], SCHEMA)
    assert hard_negatives.mine(only, only, stage).count() == 0
    assert hard_negatives.mine(only, empty, stage).count() == 0
