"""Data-quality jobs over whole tables.

All checks return violations ``(table, rule, key, detail)``.  Row rules of one
table share a single scan; keys use a partial aggregate, so a value repeated by
a third of the rows is combined before it is shuffled; so do references, whose
distinct values meet the stored parents before any row is looked at.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tiffin.contracts import TABLES, Contract
from tiffin.functions import rules
from tiffin.operators.skew import first_per_key, spread_join

Tables = Mapping[str, DataFrame]
Stage = Callable[[DataFrame], DataFrame]
RowRule = tuple[str, Column, Column]  # rule name, violated?, detail


def key_text(columns: Sequence[str]) -> Column:
    """The key columns as one text; a NULL part shows as the word NULL."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns])


def not_null_rules(contract: Contract) -> list[RowRule]:
    required = [c.name for c in contract.columns if c.required]
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in required])
    return [("not_null", reduce(or_, [F.col(c).isNull() for c in required]), missing)]


def domain_rules(contract: Contract) -> list[RowRule]:
    return [(f"domain_{c.name}", ~F.col(c.name).isin(*c.domain), F.col(c.name))
            for c in contract.columns if c.domain]


def length_rules(contract: Contract) -> list[RowRule]:
    return [(f"length_{c.name}", F.char_length(F.col(c.name)) > c.length,
             F.char_length(F.col(c.name)).cast("string"))
            for c in contract.columns if c.length]


def check_rules(contract: Contract) -> list[RowRule]:
    return [(name, ~F.expr(condition), F.lit(condition))
            for name, condition in contract.checks.items()]


def row_rules(contract: Contract) -> list[RowRule]:
    return (not_null_rules(contract) + domain_rules(contract) + length_rules(contract)
            + check_rules(contract))


def violations_by_row(df: DataFrame, table: str, row_rules_: Iterable[RowRule],
                      key: Sequence[str] | None = None) -> DataFrame:
    """Every violated rule of every row, in one scan.

    The plain test comes first: sound rows, nearly all of them, never reach the
    array of findings.
    """
    row_rules_ = list(row_rules_)
    any_failed = reduce(or_, [F.coalesce(violated, F.lit(False)) for _, violated, _ in row_rules_])
    failed = F.array_compact(F.array(*[
        F.when(violated, F.struct(F.lit(name).alias("rule"), detail.cast("string").alias("detail")))
        for name, violated, detail in row_rules_]))
    key = key or TABLES[table].key
    return (df.filter(any_failed)
            .select(key_text(key).alias("key"), F.explode(failed).alias("_v"))
            .select(F.lit(table).alias("table"), F.col("_v.rule").alias("rule"), "key",
                    F.col("_v.detail").alias("detail")))


def check_not_null(df: DataFrame, table: str) -> DataFrame:
    return violations_by_row(df, table, not_null_rules(TABLES[table]))


def check_domain(df: DataFrame, table: str) -> DataFrame:
    return violations_by_row(df, table, domain_rules(TABLES[table]))


def check_length(df: DataFrame, table: str) -> DataFrame:
    return violations_by_row(df, table, length_rules(TABLES[table]))


def check_expr(df: DataFrame, table: str, only: Sequence[str] | None = None) -> DataFrame:
    """The CHECK conditions of the contract, or those named in ``only``."""
    chosen = [r for r in check_rules(TABLES[table]) if only is None or r[0] in only]
    return violations_by_row(df, table, chosen)


def check_unique(df: DataFrame, table: str, columns: Sequence[str], rule: str = "unique") -> DataFrame:
    """Values of ``columns`` held by several rows; NULLs are exempt.  ``detail`` is the row count."""
    return (first_per_key(df, columns, columns[0])
            .filter(F.col("n") > 1)
            .select(F.lit(table).alias("table"), F.lit(f"{rule}_{'_'.join(columns)}").alias("rule"),
                    key_text(columns).alias("key"), F.col("n").cast("string").alias("detail")))


def check_key(df: DataFrame, table: str) -> DataFrame:
    return check_unique(df, table, TABLES[table].key, "key")


def check_foreign_key(child: DataFrame, table: str, column: str, parent: DataFrame,
                      parent_column: str) -> DataFrame:
    """Non-NULL references without a parent row."""
    parents = parent.select(F.col(parent_column).alias(column))
    return (child.filter(F.col(column).isNotNull())
            .join(parents, column, "left_anti")
            .select(F.lit(table).alias("table"), F.lit(f"foreign_key_{column}").alias("rule"),
                    key_text(TABLES[table].key).alias("key"),
                    F.col(column).cast("string").alias("detail")))


def check_keys(tables: Tables, names: Iterable[str]) -> DataFrame:
    """All primary and unique keys of the named tables.

    Keys of one type share an aggregate and its shuffle, in their own types: all
    BIGINT ids together, all texts together, and so on.
    """
    by_type: dict[tuple[str, ...], list[tuple[str, str, tuple[str, ...]]]] = defaultdict(list)
    for name in names:
        contract = TABLES[name]
        for rule, columns in [("key", contract.key), *[("unique", u) for u in contract.unique]]:
            types = tuple(tables[name].schema[c].dataType.simpleString() for c in columns)
            by_type[types].append((name, f"{rule}_{'_'.join(columns)}", columns))
    return _union([_repeated_keys(tables, checks) for checks in by_type.values()])


def _repeated_keys(tables: Tables, checks: list[tuple[str, str, tuple[str, ...]]]) -> DataFrame:
    keys = [f"_k{i}" for i in range(len(checks[0][2]))]
    parts = [tables[name].select(F.lit(i).alias("_check"), *[F.col(c).alias(k) for c, k in zip(columns, keys)])
             for i, (name, _, columns) in enumerate(checks)]
    return (first_per_key(_union(parts), ["_check", *keys], keys[0])
            .filter(F.col("n") > 1)
            .select(_pick([c[0] for c in checks]).alias("table"), _pick([c[1] for c in checks]).alias("rule"),
                    key_text(keys).alias("key"), F.col("n").cast("string").alias("detail")))


def check_references(tables: Tables, names: Iterable[str], stage: Stage = lambda df: df) -> DataFrame | None:
    """All foreign keys of the named tables whose parent is given, None if there are none.

    Values first, rows after.  Every child is read once and gives its references, each
    with the parent it names; they are made distinct before they are shuffled, so a value
    that a third of the rows refer to travels once per task, and one join with the
    keys of all parents finds the values without one.  Only then are the rows that hold
    such a value looked up, by a join with what is usually a short list, and their keys
    rendered as text.  ``stage=durable`` stores that list, so that its size decides the
    join, and an empty one ends the search.
    """
    parents: list[tuple[str, str]] = []
    children: dict[str, list[tuple[int, str]]] = {}
    for name in names:
        for fk in TABLES[name].foreign:
            if fk.parent in tables:
                if (fk.parent, fk.parent_column) not in parents:
                    parents.append((fk.parent, fk.parent_column))
                children.setdefault(name, []).append((parents.index((fk.parent, fk.parent_column)), fk.column))
    if not children:
        return None
    value = [f"r.{c}" for c in _REFERENCE]
    given = _union([tables[name].select(_reference(tables[name], i, column).alias("r")).filter("r IS NOT NULL").select(*value)
                    for i, (name, column) in enumerate(parents)])
    asked = _union([tables[name].select(F.explode(_references(tables[name], refs)).alias("r")).select(*value)
                    for name, refs in children.items()])
    # an anti join would be pushed below the union and read all parents once per child
    lost = stage(asked.distinct().join(given.withColumn("_there", F.lit(True)), _REFERENCE, "left")
                 .filter(F.col("_there").isNull()).drop("_there"))
    found = []
    for name, refs in children.items():
        texts = [c for _, c in refs if _is_text(tables[name], c)]
        rows = tables[name].select(*TABLES[name].key, F.explode(_references(tables[name], refs)).alias("r"))
        found.append(rows.select("*", "r.*").drop("r").join(lost, _REFERENCE).select(
            F.lit(name).alias("table"), F.concat(F.lit("foreign_key_"), "column").alias("rule"),
            key_text(TABLES[name].key).alias("key"),
            F.when(F.col("column").isin(texts), F.col("text")).otherwise(F.col("number").cast("string")).alias("detail")))
    return _union(found)


#: A reference: the number of its parent, and its value as a number or a text; the other is 0 or empty.
_REFERENCE = ["parent", "number", "text"]


def _is_text(rows: DataFrame, column: str) -> bool:
    return rows.schema[column].dataType.typeName() == "string"


def _reference(rows: DataFrame, parent: int, column: str) -> Column:
    """NULL for NULL; the name of the column comes last."""
    number, text = (F.lit(0), F.col(column)) if _is_text(rows, column) else (F.col(column), F.lit(""))
    return F.when(F.col(column).isNotNull(), F.struct(
        F.lit(parent).alias("parent"), number.cast("long").alias("number"), text.alias("text"), F.lit(column).alias("column")))


def _references(rows: DataFrame, refs: Sequence[tuple[int, str]]) -> Column:
    return F.array_compact(F.array(*[_reference(rows, parent, column) for parent, column in refs]))


def _pick(texts: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(t) for t in texts]), F.col("_check"))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def check_all(tables: Tables, names: Iterable[str] | None = None, stage: Stage = lambda df: df) -> DataFrame:
    """All violations of the contracts of the given tables, or of those in ``names``."""
    names = [n for n in TABLES if n in tables and (names is None or n in names)]
    found = _union([violations_by_row(tables[n], n, row_rules(TABLES[n])) for n in names])
    found = found.unionByName(check_keys(tables, names))
    orphans = check_references(tables, names, stage)
    return found if orphans is None else found.unionByName(orphans)


def check_table(tables: Tables, table: str) -> DataFrame:
    """All violations of one table's contract."""
    return check_all(tables, [table])


def split_valid(df: DataFrame, table: str,
                extra: Iterable[RowRule] = ()) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)`` by the row rules; ``rejected`` carries ``error``, the first rule broken."""
    ladder = [(violated, name) for name, violated, _ in [*row_rules(TABLES[table]), *extra]]
    judged = df.withColumn("error", rules.first_error(*ladder))
    return judged.filter(F.col("error").isNull()).drop("error"), judged.filter(F.col("error").isNotNull())


def narrow(table: DataFrame, requests: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of ``table`` whose ``columns`` some request names.

    A change set is small beside the table it changes.  The distinct request
    keys are then broadcast and the table is only scanned, where an outer join
    from the requests would have to shuffle it.
    """
    return table.join(requests.select(*columns).distinct(), list(columns), "left_semi")


def exists_in(requests: DataFrame, entity: DataFrame, keys: Mapping[str, str], found: str = "found",
              unique: bool = False, spread_by: Sequence[str] = (), collation: str | None = None) -> DataFrame:
    """``requests`` with a flag: is there a row of ``entity`` under these keys?

    ``keys`` maps request columns to entity columns.  With ``unique`` the entity
    holds each key once; otherwise its keys are made distinct first.
    ``collation`` (for example ``UNICODE_CI_AI``) compares text without case and
    accents.  The answer is found per distinct key and joined back, so a hot
    request key is counted before it is shuffled and its rows are spread.
    """
    temp = [f"_k{i}" for i in range(len(keys))]
    left = requests.withColumns(
        {t: _collated(requests, c, collation) for t, c in zip(temp, keys)})
    held = entity.select(*[_collated(entity, c, collation).alias(t) for t, c in zip(temp, keys.values())])
    asked = left.dropna(subset=temp).groupBy(*temp).agg(F.count(F.lit(1)).alias("_n"))
    hits = narrow(held, asked, temp)
    if not unique or collation:
        hits = hits.distinct()
    facts = asked.join(hits.withColumn(found, F.lit(True)), temp, "left")
    joined = spread_join(left, facts, temp, "left", spread_by or requests.columns, counted="_n")
    return joined.drop(*temp).withColumn(found, F.coalesce(F.col(found), F.lit(False)))


def _collated(df: DataFrame, column: str, collation: str | None) -> Column:
    is_text = df.schema[column].dataType.typeName() == "string"
    return F.collate(F.col(column), collation) if collation and is_text else F.col(column)


def find_duplicates(requests: DataFrame, table: DataFrame, columns: Sequence[str], seq: str = "seq",
                    counting: Column | None = None) -> DataFrame:
    """``requests`` with ``stored`` (its key is in ``table``) and ``repeated`` (an earlier row has its key).

    ``counting`` limits which earlier rows count.  Everything is decided per
    distinct key, which is joined back to the requests once.
    """
    first = first_per_key(requests, columns, seq, "_first", counting)
    known = narrow(table.select(*columns), first, columns).distinct().withColumn("_stored", F.lit(True))
    facts = first.join(known, list(columns), "left")
    return (spread_join(requests, facts, columns, "left", [seq], counts=first, counted="n")
            .withColumn("stored", F.coalesce(F.col("_stored"), F.lit(False)))
            .withColumn("repeated", F.coalesce(F.col(seq) > F.col("_first"), F.lit(False)))
            .drop("_stored", "_first"))
