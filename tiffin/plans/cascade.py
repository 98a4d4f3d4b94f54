"""Deleting rows together with everything that refers to them."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiffin.contracts import TABLES, ForeignKey
from tiffin.operators.quality import key_text

Tables = Mapping[str, DataFrame]
Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CascadeResult:
    """``tables``: the changed tables; ``deleted``: removed keys per table; ``blocked``: refused root keys."""

    tables: dict[str, DataFrame]
    deleted: dict[str, DataFrame]
    blocked: DataFrame

    def counts(self) -> DataFrame:
        """``(table, deleted)`` for every table the deletion can reach."""
        parts = [rows.agg(F.count(F.lit(1)).alias("deleted"))
                 .select(F.lit(name).alias("table"), "deleted") for name, rows in self.deleted.items()]
        return reduce(DataFrame.unionByName, parts)

    def deleted_keys(self) -> DataFrame:
        """``(table, key)`` of every removed row."""
        parts = [rows.select(F.lit(name).alias("table"), key_text(TABLES[name].key).alias("key"))
                 for name, rows in self.deleted.items()]
        return reduce(DataFrame.unionByName, parts)


def _children(parent: str, cascade: bool) -> list[tuple[str, ForeignKey]]:
    return [(name, fk) for name, contract in TABLES.items() for fk in contract.foreign
            if fk.parent == parent and fk.cascade == cascade]


def reach(root: str) -> list[str]:
    """The tables a deletion in ``root`` can reach, parents before children."""
    order: list[str] = []

    def visit(name: str) -> None:
        for child, _ in _children(name, cascade=True):
            if child not in order:
                visit(child)
        if name not in order:
            order.append(name)

    visit(root)
    return order[::-1]


def _any_edge(rows: DataFrame, edges: list[tuple[ForeignKey, DataFrame]], key: list[str]) -> DataFrame:
    """Keys of the rows that refer to a deleted parent through any edge, each once."""
    hits = [rows.join(gone.select(F.col(fk.parent_column).alias(fk.column)), fk.column, "left_semi")
            .select(*key) for fk, gone in edges]
    return hits[0] if len(hits) == 1 else reduce(DataFrame.unionByName, hits).distinct()


def _blocked_roots(tables: Tables, root: str, keys: DataFrame, root_key: str) -> DataFrame:
    """Root keys under which some reachable row is referred to by a RESTRICT edge.

    Walks down only the branches that lead to such an edge, carrying the root key.
    """
    blocked = keys.limit(0).select(F.col(root_key).alias("_root"))

    def leads_to_restrict(name: str) -> bool:
        return bool(_children(name, False)) or any(leads_to_restrict(c) for c, _ in _children(name, True))

    def walk(name: str, held: DataFrame) -> None:
        nonlocal blocked
        for child, fk in _children(name, cascade=False):
            if child in tables:
                parent = TABLES[name].key[0]
                refs = tables[child].select(F.col(fk.column).alias(parent))
                blocked = blocked.unionByName(held.join(refs.distinct(), parent, "left_semi").select("_root"))
        for child, fk in _children(name, cascade=True):
            if child in tables and leads_to_restrict(child):
                key = TABLES[child].key[0]
                rows = tables[child].select(F.col(key), F.col(fk.column).alias("_fk"))
                parent = held.select(F.col(fk.parent_column).alias("_fk"), "_root")
                walk(child, rows.join(parent, "_fk").select(key, "_root"))

    if leads_to_restrict(root):
        walk(root, keys.select(F.col(root_key), F.col(root_key).alias("_root")))
    return blocked.distinct().withColumnRenamed("_root", root_key)


def cascade_delete(tables: Tables, root: str, keys: DataFrame,
                   stage: Stage = lambda df: df) -> CascadeResult:
    """Delete the ``root`` rows with the given keys and all rows that depend on them.

    ``keys`` has the single key column of ``root``.  A key whose deletion would
    reach a RESTRICT reference is refused as a whole.  Removed counters, costs
    and quotas elsewhere are left as they are: a cascade fires no roll-up.

    Every edge is one semi join to find rows; one anti join by key keeps the rest of a table.
    Pass ``stage=durable`` in a job that writes several of the tables, so that
    each set of removed rows is computed once.
    """
    root_key = TABLES[root].key[0]
    wanted = stage(keys.select(root_key).distinct())
    blocked = stage(_blocked_roots(tables, root, wanted, root_key))
    allowed = wanted.join(blocked, root_key, "left_anti")

    deleted = {root: stage(tables[root].join(allowed, root_key, "left_semi").select(root_key))}
    kept = {root: tables[root].join(deleted[root], root_key, "left_anti").select(*tables[root].columns)}
    for name in reach(root)[1:]:
        if name not in tables:
            continue
        rows = tables[name]
        edges = [(fk, deleted[fk.parent]) for fk in TABLES[name].foreign
                 if fk.cascade and fk.parent in deleted]
        deleted[name] = stage(_any_edge(rows, edges, list(TABLES[name].key)))
        kept[name] = rows.join(deleted[name], list(TABLES[name].key), "left_anti").select(*tables[name].columns)
    return CascadeResult(kept, deleted, blocked)
