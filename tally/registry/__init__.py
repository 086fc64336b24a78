"""Every registered query over the library's own operators, with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("reports", "contest", "ingest", "parsing", "chat", "retrieval", "quiz", "streams")


def _merged(attribute: str) -> dict:
    merged: dict = {}
    for name in MODULES:
        found = getattr(import_module(f"tally.registry.{name}"), attribute)
        if twice := merged.keys() & found.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        merged |= found
    return merged


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("SQL")
