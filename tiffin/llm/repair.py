"""Conversation structure repair by Hirschberg's divide-and-conquer over four states.

A conversation is well formed if its role initials read ``(s?(ua)+)?``.  A repair edits its
rows in order: Keep (0), Rerole to user or assistant (2), Delete (3; a must for blank rows
and for duplicates), Insert an empty turn of user or assistant before a row or at the end
(2); a truncated row that stays adds 1.  Among the cheapest repairs the one whose edit
initials are least as text is taken.

The state is what was written last: nothing, system, user, assistant.  The cost of getting
from one state to another over a stretch of rows is a four-by-four matrix.  Forward costs
to the middle and backward costs from it meet there; of the crossings with the least sum
the one whose edits so far are least is taken, and both halves are solved alike.  Edits to
different crossings never are beginnings of one another (each ends with the edit of the
same row), so comparing the first halves decides.

A conversation of any length is spread out.  Rows are sorted over the cluster and cut into
stretches of at most ``2**STRETCH_BITS`` rows, each coded in two letters a row.  A stretch
that holds its whole conversation is solved at once.  Any other gives its matrix and, for
each state it starts in, the order of its edit texts by the state they end in.  Such
summaries join like matrices, at most ``2**STRETCH_BITS`` at a time, until one is left per
conversation.  On the way back the entry and exit state of every summary fix those of its
parts, and at last each stretch writes its own repair.  Texts take no part before that.

Rows: a null role or text is one space.  Conversations without id are one conversation.
Null turns come first; rows of one turn are taken by role, then by the MD5 of their text.  Repeated rows are
duplicates.  Empty tables give nothing.  Columns besides ``conv_id, turn, role, text`` are
left out, as an inserted turn would have none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.llm import words as W

Stage = Callable[[DataFrame], DataFrame]

#: A stretch has at most two to this power rows, a summary as many parts.
STRETCH_BITS = 12
#: Coded stretches of up to so many rows whose repairs a worker remembers, and how many.
SHORT, REMEMBERED = 40, 50_000
NEVER = 1 << 40
#: States: what was written last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
_FOLLOWS = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The state after an inserted or reroled turn: an assistant answers a user, else a user speaks.
_TURN = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_INSERT, _REROLE, _DELETE, _TRUNCATED = 2, 2, 3, 1
#: Cheapest insertions between states: how many turns lead from one to the other.
_INSERTS = tuple(tuple(0 if a == b else (1 if _TURN[a] == b else (2 if _TURN[_TURN[a]] == b else None)) for b in STATES)
                 for a in STATES)
#: A row for the edits: its role initial if it may be kept as it is or reroled, and whether it must go or is truncated.
Row = tuple[str, bool, bool]

FAULTS = ("blank", "duplicate", "truncated")
_WORD = r"[^\x20\x09-\x0D]"


def step(row: Row, last: bool) -> list[list[tuple[int, str] | None]]:
    """Cheapest cost and edits from each state to each over one row: insertions, the row's edit, and
    after the last row insertions again."""
    initial, must_go, truncated = row
    moves: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]

    def offer(a: int, b: int, cost: int, edits: str) -> None:
        now = moves[a][b]
        if now is None or (cost, edits) < now:
            moves[a][b] = (cost, edits)

    for a in STATES:
        for m in STATES:
            count = _INSERTS[a][m]
            if count is None:
                continue
            before, lead = _INSERT * count, "I" * count
            offer(a, m, before + _DELETE, lead + "D")
            if not must_go:
                extra = _TRUNCATED if truncated else 0
                if m in _FOLLOWS.get(initial, {}):
                    offer(a, _FOLLOWS[initial][m], before + extra, lead + "K")
                offer(a, _TURN[m], before + extra + _REROLE, lead + "R")
    if last:
        ended: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in STATES]
        plain, moves = moves, ended
        for a in STATES:
            for m in STATES:
                for b in STATES:
                    if plain[a][m] is not None and _INSERTS[m][b] is not None:
                        cost, edits = plain[a][m]
                        offer(a, b, cost + _INSERT * _INSERTS[m][b], edits + "I" * _INSERTS[m][b])
    return moves


class Stretch:
    """Costs and least edits over consecutive rows; ``last`` if the conversation ends with them."""

    def __init__(self, rows: list[Row], last: bool):
        known: dict[tuple[Row, bool], list] = {}
        self.steps = []
        for i, row in enumerate(rows):
            key = (row, last and i == len(rows) - 1)
            if key not in known:
                known[key] = step(*key)
            self.steps.append(known[key])

    def forward(self, begin: int, end: int, start: int) -> list[int]:
        """Least cost from ``start`` to each state over rows begin..end-1."""
        cost = [NEVER] * 4
        cost[start] = 0
        for moves in self.steps[begin:end]:
            cost = [min((cost[a] + moves[a][b][0] for a in STATES if moves[a][b]), default=NEVER) for b in STATES]
        return cost

    def backward(self, begin: int, end: int, goal: int) -> list[int]:
        """Least cost from each state to ``goal``."""
        cost = [NEVER] * 4
        cost[goal] = 0
        for moves in reversed(self.steps[begin:end]):
            cost = [min((cost[b] + moves[a][b][0] for b in STATES if moves[a][b]), default=NEVER) for a in STATES]
        return cost

    def edits(self, begin: int, end: int, pairs: set[tuple[int, int]]) -> dict[tuple[int, int], str | None]:
        """The least of the cheapest edits for each pair of entry and exit state; None where no way leads."""
        if end - begin == 1:
            moves = self.steps[begin]
            return {(a, b): moves[a][b] and moves[a][b][1] for a, b in pairs}
        middle = (begin + end) // 2
        ahead = {a: self.forward(begin, middle, a) for a in {a for a, _ in pairs}}
        behind = {b: self.backward(middle, end, b) for b in {b for _, b in pairs}}
        crossings = {}
        for a, b in pairs:
            sums = [x + y for x, y in zip(ahead[a], behind[b], strict=True)]
            least = min(sums)
            crossings[a, b] = [] if least >= NEVER else [s for s in STATES if sums[s] == least]
        first = self.edits(begin, middle, {(a, s) for (a, _), some in crossings.items() for s in some})
        chosen = {(a, b): min(some, key=lambda s: first[a, s]) for (a, b), some in crossings.items() if some}
        second = self.edits(middle, end, {(s, b) for (_, b), s in chosen.items()})
        return {(a, b): first[a, chosen[a, b]] + second[chosen[a, b], b] if (a, b) in chosen else None for a, b in pairs}

    def summary(self) -> tuple[list[int], list[int]]:
        """Sixteen costs, and for each entry state the order of the edits by exit state."""
        size = len(self.steps)
        texts = self.edits(0, size, {(a, b) for a in STATES for b in STATES})
        costs, ranks = [], []
        for a in STATES:
            row = self.forward(0, size, a)
            order = sorted((b for b in STATES if texts[a, b] is not None), key=lambda b: texts[a, b])
            costs += row
            ranks += [order.index(b) if b in order else 4 for b in STATES]
        return costs, ranks


def join(left: tuple[list[int], list[int]], right: tuple[list[int], list[int]]) -> tuple[list[int], list[int]]:
    """The summary of two neighbouring stretches."""
    costs, ranks = [], []
    for a in STATES:
        keys: list[tuple[int, int] | None] = []
        for b in STATES:
            s = crossing(left, right, a, b)
            costs.append(NEVER if s is None else left[0][4 * a + s] + right[0][4 * s + b])
            keys.append(None if s is None else (left[1][4 * a + s], right[1][4 * s + b]))
        order = sorted(k for k in keys if k is not None)
        ranks += [4 if k is None else order.index(k) for k in keys]
    return costs, ranks


def crossing(left: tuple[list[int], list[int]], right: tuple[list[int], list[int]], a: int, b: int) -> int | None:
    """The state between two stretches on the least of the cheapest ways from ``a`` to ``b``."""
    sums = [left[0][4 * a + s] + right[0][4 * s + b] for s in STATES]
    least = min(sums)
    return None if least >= NEVER else min((s for s in STATES if sums[s] == least), key=lambda s: left[1][4 * a + s])


def path(parts: list[tuple[list[int], list[int]]], a: int, b: int) -> list[int]:
    """States at the ends of the parts, from ``a`` to ``b``: halves meet at their crossing."""
    if len(parts) == 1:
        return [b]
    middle = len(parts) // 2
    s = crossing(folded(parts[:middle]), folded(parts[middle:]), a, b)
    return path(parts[:middle], a, s) + path(parts[middle:], s, b)


def folded(parts: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    out = parts[0]
    for part in parts[1:]:
        out = join(out, part)
    return out


def best_end(summary: tuple[list[int], list[int]]) -> int:
    """The exit state of the least of the cheapest repairs of a conversation: nothing written, or an answered user."""
    costs, ranks = summary
    return min((NOTHING, ASSISTANT), key=lambda b: (costs[b], ranks[b]))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows after the damage that ``crc32(conv_id:turn) % 20`` names: 0 drops a row, 1 empties its text, 2 removes
    its sentence ends, 3 repeats it, 4 makes its role user.  A null in the key, the role or the text is one space."""
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                        kind.alias("_kind")).filter("_kind <> 0")
    copies = F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select(
        "conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _coded(rows: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The sorted rows with their place, and the stretches: ``conv_id, _block, _start`` and two letters a row.

    The first letter is the role initial (o: any other than s, u, a), the second b, d, t or k: blank, duplicate,
    truncated, or none.  Ranges may cut a conversation anywhere, also between equal rows.  The first row of each
    role and text is found by its place, which no key repeats."""
    sure = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    order = ["conv_id", "turn", "role", "_digest"]
    placed = stage(
        sure.withColumns({"_digest": F.md5("text"), "_spread": F.xxhash64(F.monotonically_increasing_id())})
        .repartitionByRange(*order, "_spread").sortWithinPartitions(*order).drop("_spread")
        .withColumns({"_place": F.monotonically_increasing_id(), "_blank": ~F.col("text").rlike(_WORD),
                      "_truncated": ~F.regexp_extract("text", rf"({_WORD})[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")}))
    firsts = placed.filter(~F.col("_blank")).groupBy("conv_id", "role", "_digest").agg(F.min("_place").alias("_place"))
    initial = F.when(F.substring("role", 1, 1).isin("s", "u", "a"), F.substring("role", 1, 1)).otherwise("o")
    fault = (F.when(F.col("_blank"), "b").when(F.col("_first").isNull(), "d").when(F.col("_truncated"), "t").otherwise("k"))
    coded = (placed.select("conv_id", "role", "_place", "_blank", "_truncated")
             .join(firsts.select("_place", F.lit(True).alias("_first")), "_place", "left")
             .select("conv_id", "_place", F.concat(initial, fault).alias("code")))
    inside = F.array_sort(F.collect_list(F.struct("_place", "code")))
    stretches = (coded.groupBy("conv_id", F.shiftright("_place", STRETCH_BITS).alias("_block"))
                 .agg(F.min("_place").alias("_start"), F.array_join(F.transform(inside, lambda r: r["code"]), "").alias("code")))
    return placed, stage(stretches)


def _rows(code: str) -> list[Row]:
    return [(code[i], code[i + 1] in "bd", code[i + 1] == "t") for i in range(0, len(code), 2)]


def told(code: str, edits: str, state: int) -> tuple[str, int]:
    """The edits of each row as words of two letters an edit (the second the role of a new turn), and the cost."""
    out, cost, row, word = [], 0, 0, ""
    size = len(code) // 2
    for edit in edits:
        if edit in "IR":
            state = _TURN[state]
            word += edit + ("u" if state == USER else "a")
            cost += _INSERT if edit == "I" else _REROLE
        elif edit == "K":
            state = _FOLLOWS[code[2 * row]][state]
            word += "K-"
        else:
            word += "D-"
            cost += _DELETE
        if edit != "I":
            cost += _TRUNCATED if edit != "D" and code[2 * row + 1] == "t" else 0
            row += 1
            if row < size:
                out.append(word)
                word = ""
    return " ".join([*out, word]), cost


def _solved(code: str, last: bool, entry: int, leave: int) -> tuple[str, str, int]:
    edits = Stretch(_rows(code), last).edits(0, len(code) // 2, {(entry, leave)})[entry, leave]
    return edits, *told(code, edits, entry)


def _whole(code: str) -> tuple[str, str, int]:
    """Audit, edits and cost of a conversation that one stretch holds."""
    stretch, size = Stretch(_rows(code), True), len(code) // 2
    costs = stretch.forward(0, size, NOTHING)
    least = min(costs[NOTHING], costs[ASSISTANT])
    ends = {(NOTHING, b) for b in (NOTHING, ASSISTANT) if costs[b] == least}
    edits = min(stretch.edits(0, size, ends).values())
    return edits, *told(code, edits, NOTHING)


_COUNTS = "blank long, duplicate long, truncated long, illegal long, head string, tail string"


def _counted(code: str) -> tuple:
    faults, initials = code[1::2], code[::2]
    legal = sum(initials.startswith(p, i) for i in range(len(initials) - 1) for p in ("su", "ua", "au"))
    return faults.count("b"), faults.count("d"), faults.count("t"), len(initials) - 1 - legal, initials[0], initials[-1]


def _summaries(stretches: DataFrame) -> DataFrame:
    """Counts of each stretch, with its repair where it holds its whole conversation, else with its summary."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for batch in batches:
            made = []
            for code, first, last in zip(*(batch.column(n).to_pylist() for n in ("code", "_first", "_last")), strict=True):
                if not (first and last):
                    made.append((*_counted(code), None, None, None, *Stretch(_rows(code), last).summary()))
                    continue
                found = known.get(code)
                if found is None:
                    found = (*_counted(code), *_whole(code), None, None)
                    if len(code) <= 2 * SHORT and len(known) < REMEMBERED:
                        known[code] = found
                made.append(found)
            new = pa.array([dict(zip(names, m, strict=True)) for m in made], pa.struct(list(zip(names, kinds, strict=True))))
            yield pa.RecordBatch.from_arrays([*batch.columns, *new.flatten()], names=[*batch.schema.names, *names])

    text, number = pa.string(), pa.int64()
    names = ["blank", "duplicate", "truncated", "illegal", "head", "tail", "audit", "edits", "cost", "costs", "ranks"]
    kinds = [number] * 4 + [text] * 4 + [number, pa.list_(number), pa.list_(number)]
    fields = "conv_id long, _block long, _start long, code string, _first boolean, _last boolean"
    return stretches.mapInArrow(
        W.lean(run), f"{fields}, {_COUNTS}, audit string, edits string, cost long, costs array<long>, ranks array<long>")


def _parts(frame: pd.DataFrame) -> list[tuple[list[int], list[int]]]:
    return [(list(c), list(r)) for c, r in zip(frame["costs"], frame["ranks"], strict=True)]


def _entries(parts: DataFrame, stage: Stage) -> DataFrame:
    """``conv_id, idx, entry, leave`` of each part (conv_id, idx, costs, ranks) on the least of the cheapest repairs."""
    levels = [stage(parts)]
    many = True
    while many:
        def fold(frame: pd.DataFrame) -> pd.DataFrame:
            costs, ranks = folded(_parts(frame.sort_values("idx")))
            return pd.DataFrame({"conv_id": frame["conv_id"].iloc[:1], "idx": frame["up"].iloc[:1], "costs": [costs], "ranks": [ranks]})

        below = levels[-1].withColumn("up", F.shiftright("idx", STRETCH_BITS))
        levels.append(stage(below.groupBy("conv_id", "up").applyInPandas(
            fold, "conv_id long, idx long, costs array<long>, ranks array<long>")))
        many = not levels[-1].groupBy("conv_id").count().filter("count > 1").isEmpty()

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield pd.DataFrame({"conv_id": frame["conv_id"], "idx": frame["idx"], "entry": NOTHING,
                                "leave": [best_end(p) for p in _parts(frame)]})

    shape = "conv_id long, idx long, entry int, leave int"
    known = levels[-1].mapInPandas(ends, shape)
    for level in levels[-2::-1]:
        def split(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values("idx")
            leave = path(_parts(frame), int(frame["entry"].iloc[0]), int(frame["leave"].iloc[0]))
            return pd.DataFrame({"conv_id": frame["conv_id"], "idx": frame["idx"],
                                 "entry": [int(frame["entry"].iloc[0]), *leave[:-1]], "leave": leave})

        above = known.select(F.col("conv_id").alias("_conv"), F.col("idx").alias("up"), "entry", "leave")
        below = level.withColumn("up", F.shiftright("idx", STRETCH_BITS))
        met = below.join(above, (below["up"] == above["up"]) & below["conv_id"].eqNullSafe(above["_conv"])).select(
            "conv_id", "idx", "costs", "ranks", below["up"], "entry", "leave")
        known = stage(met.groupBy("conv_id", "up").applyInPandas(split, shape))
    return known


def _finished(open_ones: DataFrame) -> DataFrame:
    """Audit, edits and cost of stretches whose entry and exit state are known."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_solved(*r) for r in zip(*(batch.column(n).to_pylist() for n in ("code", "_last", "entry", "leave")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.string(), pa.int64())))],
                names=["conv_id", "_block", "audit", "edits", "cost"])

    return open_ones.select("conv_id", "_block", "code", "_last", "entry", "leave").mapInArrow(
        W.lean(run), "conv_id long, _block long, audit string, edits string, cost long")


def solve(rows: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """The sorted rows (``_place``), and per stretch its first place, counts, cost, ``audit`` and the edits of each row."""
    placed, stretches = _coded(rows, stage)
    ends = stretches.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("_block").alias("_from"), F.max("_block").alias("_to"))
    marked = stretches.join(ends, stretches["conv_id"].eqNullSafe(ends["_conv"])).select(
        "conv_id", "_block", "_start", "code", (F.col("_block") == F.col("_from")).alias("_first"),
        (F.col("_block") == F.col("_to")).alias("_last"))
    tried = stage(_summaries(marked))
    out = ["conv_id", "_block", "_start", "blank", "duplicate", "truncated", "illegal", "head", "tail", "audit", "edits", "cost"]
    waiting = tried.filter(F.col("audit").isNull())
    if waiting.isEmpty():
        return placed, tried.select(*out)
    states = _entries(waiting.select("conv_id", F.col("_block").alias("idx"), "costs", "ranks"), stage).select(
        F.col("conv_id").alias("_conv"), "idx", "entry", "leave")
    same = (waiting["_block"] == states["idx"]) & waiting["conv_id"].eqNullSafe(states["_conv"])
    made = _finished(waiting.join(states, same)).select(F.col("conv_id").alias("_conv"), F.col("_block").alias("idx"), "audit", "edits", "cost")
    rest = waiting.drop("audit", "edits", "cost")
    same = (rest["_block"] == made["idx"]) & rest["conv_id"].eqNullSafe(made["_conv"])
    return placed, stage(tried.filter(F.col("audit").isNotNull()).select(*out).unionByName(rest.join(made, same).select(*out)))


def edited(placed: DataFrame, solved: DataFrame) -> DataFrame:
    """Every edit as a row: ``conv_id, _place, part, edit, turn, role, text``; order is by ``_place, part``.

    ``edit`` is K, R, D or I; a deleted row is shown as it was, a reroled one with its new role, an inserted turn has
    no turn number and an empty text."""
    words = solved.select("_start", F.posexplode(F.split("edits", " ")).alias("i", "word"))
    each = words.select((F.col("_start") + F.col("i")).alias("_place"), F.posexplode(
        F.regexp_extract_all("word", F.lit("(..)"), F.lit(1))).alias("part", "edit"))
    new = F.when(F.substring("edit", 2, 1) == "u", _NAMES[USER]).when(F.substring("edit", 2, 1) == "a", _NAMES[ASSISTANT])
    kind = F.substring("edit", 1, 1)
    return placed.join(each, "_place").select(
        "conv_id", "_place", "part", kind.alias("edit"), F.when(kind != "I", F.col("turn")).alias("turn"),
        F.coalesce(new, F.col("role")).alias("role"), F.when(kind == "I", "").otherwise(F.col("text")).alias("text"))


def repair(rows: DataFrame, stage: Stage) -> DataFrame:
    """The edits of all conversations of ``rows`` (conv_id, turn, role, text), as ``edited`` gives them."""
    return edited(*solve(rows, stage))


def report(rows: DataFrame, stage: Stage) -> DataFrame:
    """Per conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    The texts of a stretch are put together first; those of a conversation pass through one task, stretch by stretch,
    as its hash asks for, and are not kept."""
    placed, solved = solve(rows, stage)
    block = F.shiftright("_place", STRETCH_BITS).alias("_block")
    lines = (edited(placed, solved).filter("edit <> 'D'")
             .select(F.col("conv_id").alias("_conv"), block, F.struct("_place", "part", F.concat_ws(":", "role", "text").alias("line")).alias("r"))
             .groupBy("_conv", "_block").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("lines")))
    lines = lines.withColumnRenamed("_block", "_at")
    both = solved.join(lines, (solved["_block"] == lines["_at"]) & solved["conv_id"].eqNullSafe(lines["_conv"]), "left").select(
        "conv_id", "_block", "blank", "duplicate", "truncated", "illegal", "head", "tail", "cost", "audit", "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sums, audit, digest, tail, started = None, [], [], None, "", False
        done: list[tuple] = []

        def close() -> None:
            done.append((current[0], *sums, "".join(audit), digest.hexdigest()))

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], names=names)
            done.clear()
            return out

        for batch in batches:
            for conv, _, blank, double, cut, wrong, head, end, cost, part, text in zip(
                    *(batch.column(i).to_pylist() for i in range(11)), strict=True):
                if current is None or current[0] != conv:
                    if current is not None:
                        close()
                    current, sums, audit, digest, started = (conv,), [0] * 5, [], hashlib.sha256(), False
                elif tail + head not in ("su", "ua", "au"):
                    wrong += 1
                sums = [x + y for x, y in zip(sums, (blank, double, cut, wrong, cost), strict=True)]
                audit.append(part)
                tail = end
                if text is not None:
                    digest.update(("\n" + text if started else text).encode())
                    started = True
            if done:
                yield flush()
        if current is not None:
            close()
            yield flush()

    names = ["conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    ended = both.repartition("conv_id").sortWithinPartitions("conv_id", "_block").mapInArrow(
        W.lean(run), "conv_id long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    turns = placed.groupBy(F.col("conv_id").alias("_conv")).agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    return ended.join(turns, ended["conv_id"].eqNullSafe(turns["_conv"])).drop("_conv")
