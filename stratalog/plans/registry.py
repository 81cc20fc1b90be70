"""Where queries and the SQL that checks them are registered."""

from __future__ import annotations

import re
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            # "at" is a keyword where the SQL runs
            SQL[f.__name__] = re.sub(r"(?<!['\"])\bat\b(?!['\"])", '"at"', sql)
        return f

    return add
