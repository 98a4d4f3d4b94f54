import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from tiffin.llm import repair

SPACE = "\t\n\x0b\x0c\r "


def plain_best(rows):
    """Cheapest repair, then least audit, by extending every state row by row; rows are (role, text, fault)."""
    turn = {0: 2, 1: 2, 2: 3, 3: 2}
    names = {2: "user", 3: "assistant"}
    follows = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def put(states, s, option):
        if s not in states or option[:2] < states[s][:2]:
            states[s] = option

    def insert(states):
        for _ in range(3):
            for s, (cost, audit, lines) in list(states.items()):
                put(states, turn[s], (cost + 2, audit + "I", [*lines, names[turn[s]] + ":"]))
        return states

    states = {0: (0, "", [])}
    for role, text, fault in rows:
        new = {}
        for s, (cost, audit, lines) in insert(dict(states)).items():
            put(new, s, (cost + 3, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                kept = follows.get((role[:1], s))
                if kept is not None:
                    put(new, kept, (cost + extra, audit + "K", [*lines, f"{role}:{text}"]))
                put(new, turn[s], (cost + extra + 2, audit + "R", [*lines, f"{names[turn[s]]}:{text}"]))
        states = new
    return min((v for s, v in insert(states).items() if s in (0, 3)), key=lambda v: v[:2])


def plain_rows(rows):
    out, seen = [], set()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest())
    for turn, role, text in sorted(rows, key=key):
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def plain_report(rows):
    made = plain_rows(rows)
    turns = [r[0] for r in made if r[0] is not None]
    pairs = zip(made, made[1:])
    cost, audit, lines = plain_best([r[1:] for r in made])
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(sum(r[3] == f for r in made) for f in repair.FAULTS),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def random_code(rng, most):
    return "".join(rng.choice("suuuaaao") + rng.choice("kkkkbdt") for _ in range(rng.randint(1, most)))


def plain_edits(code):
    faults = {"b": "blank", "d": "duplicate", "t": "truncated", "k": None}
    return plain_best([(code[i], "", faults[code[i + 1]]) for i in range(0, len(code), 2)])[:2]


def test_halves_meet_at_the_least_repair():
    rng = random.Random(1)
    for _ in range(800):
        code = random_code(rng, 14)
        audit, words, cost = repair._whole(code)
        assert (cost, audit) == plain_edits(code)
        assert "".join(w[::2] for w in words.split(" ")) == audit and len(words.split(" ")) == len(code) // 2


def test_summaries_of_parts_lead_to_the_same_repair():
    rng = random.Random(2)
    for _ in range(300):
        code = random_code(rng, 30)
        cuts = sorted({0, len(code), *(2 * rng.randint(0, len(code) // 2) for _ in range(4))})
        parts = [code[a:b] for a, b in zip(cuts, cuts[1:])]
        summaries = [repair.Stretch(repair._rows(p), i == len(parts) - 1).summary() for i, p in enumerate(parts)]
        end = repair.best_end(repair.folded(summaries))
        states = [repair.NOTHING, *repair.path(summaries, repair.NOTHING, end)]
        made = [repair._solved(p, i == len(parts) - 1, states[i], states[i + 1]) for i, p in enumerate(parts)]
        assert (sum(m[2] for m in made), "".join(m[0] for m in made)) == plain_edits(code)


def random_turns(rng):
    texts = ["Yes.", "No!", "no end", " \n", "", None, "Why? ", "Tail .\t", "x" * 3000 + ".", "é…", "日本?"]
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
    rows = []
    for conv in [*range(40), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2 * turn]), rng.choice(roles), rng.choice(texts)))
    rows += [(100, i, ("user", "assistant")[i % 2], f"{i % 7}" + ".?x"[i % 3]) for i in range(150)]
    rows += [(101, 5, "user", "same.")] * 60 + [(101, None, "assistant", "none")] * 9
    return rows


@pytest.mark.parametrize("bits", [12, 2])
def test_conversations_in_stretches(spark, stage, monkeypatch, bits):
    monkeypatch.setattr(repair, "STRETCH_BITS", bits)
    rows = random_turns(random.Random(5))
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    grouped = defaultdict(list)
    for conv, turn, role, text in rows:
        grouped[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {r.conv_id: r for r in repair.report(table.repartition(5), stage).collect()}
    assert set(out) == set(grouped)
    for conv, own in grouped.items():
        r = out[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) == plain_report(own)


def test_edits_as_rows(spark, stage):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Again."), (1, 2, "user", ""), (2, 0, "system", "Be."), (2, 1, "tool", "x")]
    out = repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), stage)
    found = [tuple(r)[:1] + tuple(r)[3:] for r in out.orderBy("conv_id", "_place", "part").collect()]
    assert [f[1] for f in found] == list(plain_audits(rows))
    assert found == [(1, "K", 0, "user", "Hi."), (1, "R", 1, "assistant", "Again."), (1, "D", 2, "user", ""),
                     (2, "K", 0, "system", "Be."), (2, "I", None, "user", ""), (2, "R", 1, "assistant", "x")]


def plain_audits(rows):
    for conv in (1, 2):
        yield from plain_report([r[1:] for r in rows if r[0] == conv])[6]


def plain_damage(rows):
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def test_damage(spark):
    rows = random_turns(random.Random(6))
    out = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    key = lambda r: tuple((v is not None, v if v is not None else 0) if not isinstance(v, str) else v for v in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(plain_damage(rows), key=key)


def test_empty(spark, stage):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.report(repair.damaged(empty), stage).count() == 0
