"""All registered queries."""

from __future__ import annotations

from taskledger.plans.registry import CHECKS, QUERIES, Query


def all_queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def all_checks() -> dict[str, str]:
    _load()
    return dict(CHECKS)


def _load() -> None:
    from taskledger.plans import (  # noqa: F401
        constraint_queries,
        graph_queries,
        log_queries,
        memo_queries,
        quality_queries,
        run_queries,
    )
