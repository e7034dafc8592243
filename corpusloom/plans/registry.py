"""Registering queries by name, with the SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable


def registrar(queries: dict, oracle: dict) -> Callable:
    """A decorator `query(sql)` that puts a function and its SQL, if any, into the two dictionaries."""

    def query(sql: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            queries[f.__name__] = f
            if sql:
                oracle[f.__name__] = sql
            return f

        return register

    return query
