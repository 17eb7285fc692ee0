"""Registry of queries: each Spark callable next to the ANSI SQL that must agree."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.fixtures import CTES, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def with_fixtures(sql: str) -> str:
    """Prefix a query with the fixture CTEs it names, dependencies first."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name, body in CTES.items():
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(body)
                if name not in needed:
                    needed.append(name)

    need(sql)
    if not needed:
        return sql.strip()
    ctes = ",\n".join(f"{n} AS ({CTES[n]})" for n in needed)
    body = sql.strip()
    recursive = bool(re.match(r"(?i)with\s+recursive\b", body))
    head = "WITH RECURSIVE" if recursive else "WITH"
    m = re.match(r"(?i)with(\s+recursive)?\s+", body)
    if m:
        return f"{head} {ctes},\n{body[m.end():]}"
    return f"{head} {ctes}\n{body}"


def query(name: str, sql: str | None = None):
    """Register ``fn(fixtures) -> DataFrame`` under ``name`` with its SQL twin."""

    def register(fn):
        assert name not in QUERIES, name
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = with_fixtures(sql)
        return fn

    return register


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 6) + F.lit(0.0)


def r4(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c, 4) + F.lit(0.0)


def R6(e: str) -> str:
    return f"(round({e}, 6) + 0e0)"


def R4(e: str) -> str:
    return f"(round({e}, 4) + 0e0)"
