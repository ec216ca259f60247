"""All queries of the core operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ["retrieval", "admin", "pages", "code", "more", "checks", "analysis", "acquire", "complete"]


def _all(name: str) -> dict:
    import importlib

    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"sparkloom.plans.{module}"), name)
    return out


def queries() -> dict[str, Query]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
