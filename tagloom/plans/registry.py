"""All registered queries of the price-tag engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from tagloom.sources.adapters import with_views

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
PLAIN_SQL: dict[str, str] = {}  # the same without the definitions of views


def query(sql: str | None = None, *views: str):
    """Register a function of (spark, sf_dir) under its name, with its twin in SQL over the named views."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__], PLAIN_SQL[f.__name__] = with_views(sql, *views), sql
        return f

    return put


for _name in ("reporting_queries", "text_queries", "track_queries", "catalog_queries", "fuzzy_queries", "evaluation_queries", "recovery_queries", "frame_queries", "rule_queries", "stream_queries", "file_queries"):
    import_module(f"tagloom.plans.{_name}")
