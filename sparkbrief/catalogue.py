"""All registered queries of the library, by name, with the SQL that another engine may run over the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import adapters, brief, frames, recall, sections, sessions, streams

_MODULES = (recall, sessions, sections, brief, frames, streams, adapters)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
