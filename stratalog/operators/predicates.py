"""Predicates of the store as columns, so that filters reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = {"doc": ("file", "chunk", "annotation"), "code": ("symbol", "codechunk"), "memory": ("memory",)}
EMBEDDABLE = ("memory", "chunk", "codechunk", "symbol", "annotation")


def scope(project: int | None = None, everything: bool = False) -> Column:
    """All, only global, or a project with the global rows."""
    if everything:
        return F.lit(True)
    none = F.col("project_id").isNull()
    return none if project is None else none | (F.col("project_id") == project)


def live(at: int | None = None) -> Column:
    """Not deleted now, or existing at a time."""
    if at is None:
        return F.col("deleted_at").isNull()
    return (F.col("created_at") <= at) & (F.col("deleted_at").isNull() | (F.col("deleted_at") > at))


def meta(key: str, column: str = "meta") -> Column:
    """Text of a key of valid JSON; broken JSON has none."""
    return F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{key}", "string")


def expired(at: int) -> Column:
    e = meta("expires_at").try_cast("long")
    return F.coalesce(e <= at, F.lit(False))


def visible(at: int, include_retired: bool = False) -> Column:
    """Whether a hit may be shown: not superseded and not expired, or everything."""
    return F.lit(True) if include_retired else F.col("superseded_by").isNull() & ~expired(at)


def valid_at(at: int) -> Column:
    """True, false, or null where no interval is declared."""
    a, b = meta("valid_from").try_cast("long"), meta("valid_to").try_cast("long")
    told = a.isNotNull() | b.isNotNull()
    return F.when(told, F.coalesce(a <= at, F.lit(True)) & F.coalesce(b > at, F.lit(True)))


def kinds(name: str) -> Column:
    return F.lit(True) if name == "all" else F.col("kind").isin(*ALIASES.get(name, (name,)))


def tagged(tag: str) -> Column:
    return F.array_contains(F.split(F.coalesce("tags_text", F.lit("")), " "), tag)


def live_memory() -> Column:
    return (F.col("kind") == "memory") & F.col("deleted_at").isNull() & F.col("superseded_by").isNull()


def buried() -> Column:
    """A memory deleted on purpose, not archived."""
    return (F.col("kind") == "memory") & F.col("deleted_at").isNotNull() & (F.coalesce(meta("archived"), F.lit("")) == "")


def briefable() -> Column:
    return live_memory() & F.col("subkind").isin("gotcha", "decision")
