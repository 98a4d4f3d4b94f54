import random

import numpy as np
import pytest

from plain import plain_words
from tiffin.llm import neardup
from tiffin.llm.components import components
from tiffin.session import Stage


def brute(rows, shingle=5):
    sets = {}
    for d, t in rows:
        w = plain_words("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets[d] = {tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def texts(seed, families=6, members=25):
    """Families of edited copies around a base, chains of edits, shared passages, short texts."""
    rng = random.Random(seed)

    def word():
        return "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 6)))

    passage = [word() for _ in range(30)]
    out = ["", None, "one", "ONE", "one two", "a b c d e", "A b c d e", "  \t\n"]
    for f in range(families):
        base = [word() for _ in range(rng.randint(20, 120))]
        current = list(base)
        for _ in range(members):
            edited = list(current if f % 2 else base)
            for _ in range(rng.randint(0, 4)):
                edited[rng.randrange(len(edited))] = word()
            if f % 2:
                current = edited
            out.append(" ".join(edited))
    for _ in range(40):
        body = [word() for _ in range(60)]
        body[10:10] = passage
        out.append(" ".join(body))
    return out


@pytest.mark.parametrize("seed, block_rows, block_shingles", [(1, 4096, 1 << 20), (2, 8, 300)])
def test_equals_brute_force(documents, spark, rows, seed, block_rows, block_shingles):
    made = rows(*texts(seed))
    out = neardup.near_duplicates(documents(made), Stage(spark), block_rows=block_rows, block_shingles=block_shingles).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute([(r[0], r[1]) for r in made])
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_edge_rows(documents, rows, stage):
    made = [*rows("a b c d e f", "a b c d e f"), (None, "a b c d e f", *[None] * 6), (9, None, *[None] * 6)]
    out = neardup.near_duplicates(documents([*made, made[1]]), stage).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out) == [
        (0, 0, True), (1, 1, True), (2, 1, False), (2, 1, False), (9, 9, True)]


def test_empty_table(documents, stage):
    assert neardup.near_duplicates(documents([], 1), stage).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    for size, shared in ((3, 2), (40, 30), (800, 640)):
        agreed = []
        for _ in range(60):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            b = np.concatenate([a[:shared], rng.integers(0, 2**63, size - shared).astype(np.uint64)])
            agreed.append((neardup.sketch(np.unique(a), 128) == neardup.sketch(np.unique(b), 128)).mean())
        assert abs(np.mean(agreed) - shared / (2 * size - shared)) < 0.06


def test_components_of_a_long_chain(spark, stage):
    n = 300
    order = list(range(n))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([*zip(order, order[1:]), (1000, 1001), (5, 5), (None, 3)], "a long, b long")
    found = {r.node: r.component for r in components(links, stage).collect()}
    assert found == {**{i: 0 for i in range(1, n)}, 1001: 1000}
