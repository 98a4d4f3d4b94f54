import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import plain_words
from tiffin.llm import mixing, sharding


def test_hypergeometric_follows_its_law(spark):
    """Means and variances of many draws, and the edges."""
    n = 4000
    for total, good, drawn in ((50, 20, 10), (1000, 3, 500), (10**6, 4 * 10**5, 10**4)):
        draw = sharding.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), sharding.uniform(1, F.col("id")))
        mean, var, low, high = spark.range(n).select(draw.alias("x")).agg(
            F.avg("x"), F.var_pop("x"), F.min("x"), F.max("x")).first()
        share = good / total
        true = drawn * share * (1 - share) * (total - drawn) / (total - 1)
        assert abs(mean - drawn * share) < 5 * (true / n) ** 0.5
        assert abs(var / true - 1) < 0.15
        assert low >= max(0, drawn + good - total) and high <= min(drawn, good)
    for total, good, drawn, expected in ((5, 0, 3, 0), (5, 5, 3, 3), (5, 2, 0, 0), (5, 2, 5, 2), (1, 1, 1, 1)):
        x = sharding.hypergeometric(F.lit(total), F.lit(good), F.lit(drawn), F.lit(0.7))
        assert spark.range(1).select(x).first()[0] == expected


@pytest.mark.parametrize("group", [512, 2])
def test_matrix_adds_up(spark, stage, group):
    sizes = [7, 0, 13, 101, 1, 20, 3]
    frame = spark.createDataFrame(list(enumerate(sizes)), "part long, rows long")
    made = {r.part: r.counts for r in sharding.communication_matrix(frame, stage, 4, 3, group).collect()}
    assert [sum(made[i]) for i in range(7)] == sizes
    columns = np.array([made[i] for i in range(7)]).sum(axis=0)
    assert columns.sum() == sum(sizes) and columns.max() - columns.min() <= 1


def test_shards_are_exact_and_slots_gapless(documents, rows, stage):
    made = rows(*[f"t{i}" for i in range(101)], None, "", "w " * 5000)
    table = documents([*made, *[made[5]] * 50, (None, None, *[None] * 6)], 5)
    out = sharding.shuffle_into_shards(table, stage, 4, slice_rows=10).collect()
    assert Counter(r.doc_id for r in out) == Counter([*(m[0] for m in made), *[6] * 50, None])
    counts = Counter(r.shard for r in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == {0, 1, 2, 3}
    for s in counts:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(counts[s]))


def test_every_row_reaches_every_shard_alike(spark, stage):
    seen = Counter()
    for seed in range(24):
        out = sharding.shuffle_into_shards(spark.range(0, 40, 1, 3), stage, 4, seed=seed)
        seen.update((r.id < 20, r.shard) for r in out.collect())
    assert all(abs(n - 24 * 5) < 45 for n in seen.values()) and len(seen) == 8


def test_sharding_of_an_empty_table(documents, stage):
    assert sharding.shuffle_into_shards(documents([], 1), stage, 4).count() == 0


def plain_targets(sizes, weights, share, cap):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    fixed = {}
    while True:
        free = [n for n in names if n not in fixed]
        left = share * sum(sizes.values()) - sum(fixed.values())
        aim = {n: left * weight[n] / sum(weight[m] for m in free) for n in free}
        over = [n for n in free if aim[n] > cap * sizes[n]]
        if not over:
            return {**fixed, **aim}
        fixed.update({n: cap * sizes[n] for n in over})


def test_targets_equal_clamping_in_rounds(spark):
    rng = random.Random(4)
    for sizes in ({"a": 10, "b": 1000, None: 5, "B": 40, "é": 0}, {f"s{i}": rng.randint(0, 900) for i in range(15)}):
        frame = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
        for share, cap in ((1.5, 2), (0.4, 1)):
            got = {r.source: r.target for r in mixing.targets(frame, (5, 2, 1), share, cap).collect()}
            assert got == pytest.approx(plain_targets(sizes, (5, 2, 1), share, cap))


@pytest.mark.parametrize("digits", [1, 4])
def test_taken_words_meet_the_targets(documents, rows, stage, digits):
    rng = random.Random(2)
    made = rows(*["w " * rng.randint(0, 60) for _ in range(200)], None, "", "v " * 9000)
    made = [(*m[:3], None if m[0] % 7 == 0 else m[3], *m[4:]) for m in made] + [made[3]] * 20
    out = mixing.mix(documents(made), stage, slice_digits=digits).collect()
    assert len(out) == len(made)
    for source in {r.source for r in out}:
        some = [r for r in out if r.source == source]
        assert sum(r["size"] for r in some) == some[0].source_size
        assert abs(sum(r.taken for r in some) - some[0].target) <= 0.5
    assert all(0 <= r.taken <= 2 * r["size"] and r["size"] == len(plain_words(r.text)) for r in out)


def test_the_mix_holds_the_words_taken(documents, rows, stage):
    made = rows(*[f"a b{i} c d\n e" for i in range(30)], None, "")
    mixed = mixing.mix(documents(made), stage)
    taken = sum(r.taken for r in mixed.collect())
    out = mixing.repeat(mixed, ["doc_id", "text", "n_chars"]).collect()
    assert sum(len(plain_words(r.text)) for r in out) == taken


def test_mixing_an_empty_table(documents, stage):
    assert mixing.mix(documents([], 1), stage).count() == 0
