"""The registered queries, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def load() -> tuple[dict[str, Callable], dict[str, str]]:
    from . import cue_queries, file_queries, frame_queries, run_queries, text_queries  # noqa: F401  they register themselves

    return dict(QUERIES), dict(SQL)
