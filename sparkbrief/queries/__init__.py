"""The catalogue's queries: operators applied to the test tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable


def registry() -> tuple[dict, dict, Callable]:
    """Two tables by name and a decorator that fills them."""
    found, oracles = {}, {}

    def register(sql: str | None = None):
        def add(f):
            found[f.__name__] = f
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return add

    return found, oracles, register
