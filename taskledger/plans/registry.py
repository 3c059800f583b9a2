"""Named queries over the given tables, each with its check in SQL where SQL can say it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from taskledger.plans.relations import RELATIONS

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def query(sql: str | None = None, *, recursive: bool = False, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query. Relations named in `sql` are put in front of it as common table expressions."""

    def add(fn: Query) -> Query:
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql is not None:
            CHECKS[key] = with_relations(sql, recursive)
        return fn

    return add


def with_relations(sql: str, recursive: bool = False) -> str:
    needed: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in RELATIONS.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text, re.IGNORECASE):
                needed.add(name)
                todo.append(body)
    parts = [f"{name} AS ({RELATIONS[name].strip()})" for name in RELATIONS if name in needed]
    body = sql.strip()
    extra = re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.IGNORECASE)
    if extra:
        body = body[extra.end():]
        head = ",\n".join(parts) + (",\n" if parts else "")
        return f"WITH {'RECURSIVE ' if recursive else ''}{head}{body}"
    return f"WITH {',\n'.join(parts)}\n{body}" if parts else body
