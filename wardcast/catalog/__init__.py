"""Every operator as a runnable query over the test tables."""

from __future__ import annotations

from importlib import import_module

from wardcast.catalog.registry import QUERIES, SQL

SECTIONS = ["files", "cleaning", "features", "series", "relations", "bands", "decisions", "learning", "percity", "requests", "streams"]


def _load() -> None:
    for section in SECTIONS:
        import_module(f"wardcast.catalog.{section}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
