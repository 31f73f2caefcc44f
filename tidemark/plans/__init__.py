"""Queries over the test tables, one per operator, and the same in SQL."""

from __future__ import annotations

from . import linear, reduce, windows
from .common import Query


def _all() -> dict[str, tuple[Query, str | None]]:
    return windows.PLANS | reduce.PLANS | linear.PLANS


def queries() -> dict[str, Query]:
    return {name: query for name, (query, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _all().items() if sql}
