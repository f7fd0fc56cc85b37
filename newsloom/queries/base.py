"""Registry of checked queries: a Spark callable and, where SQL can say it, the oracle text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from newsloom.queries.oracle_tables import FRAGMENTS
from newsloom.sources.tables import Desk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_tables(body: str) -> str:
    """Prefix ``body`` with the derived-table CTEs it mentions, dependencies first."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in FRAGMENTS:
            if name not in order and re.search(rf"(?i)\b(from|join)\s+{name}\b", text):
                need(FRAGMENTS[name])
                if name not in order:
                    order.append(name)

    need(body)
    body = body.strip()
    parts = [f"{name} AS ({FRAGMENTS[name].strip()})" for name in order]
    if body[:4].upper() == "WITH":
        recursive = "RECURSIVE " if body[4:].lstrip()[:9].upper() == "RECURSIVE" else ""
        rest = re.sub(r"(?is)^with\s+(recursive\s+)?", "", body)
        return f"WITH {recursive}" + ",\n".join([*parts, rest])
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(desk) -> DataFrame`` under ``name``, with its oracle if there is one."""

    def register(fn: Callable[[Desk], DataFrame]) -> Callable[[Desk], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, folder: fn(Desk(spark, folder))
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return fn

    return register
