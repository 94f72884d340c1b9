"""Query registry: one entry per operator, each with an optional DuckDB check query.

Check queries are written against a small library of common table expressions
(``cte``); ``assemble`` prefixes a query with exactly the expressions it uses.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from stockloom.sources.adapters import Source


@dataclass(frozen=True)
class Query:
    op_id: str
    name: str
    build: Callable[[Source], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        return self.build(Source(spark, path))


QUERIES: dict[str, Query] = {}
_CTES: dict[str, str] = {}
_WORD = re.compile(r"[A-Za-z_]\w*")


def cte(name: str, body: str) -> None:
    if name in _CTES:
        raise ValueError(f"duplicate expression {name}")
    _CTES[name] = body.strip()


def query(op_id: str, name: str, sql: str | None = None):
    """Register a query builder under ``name``."""

    def register(build):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(op_id, name, build, sql)
        return build

    return register


def assemble(sql: str) -> str:
    """Prefix ``sql`` with the library expressions it needs, in dependency order."""
    ordered: list[str] = []

    def visit(text: str, path: tuple[str, ...]) -> None:
        for word in dict.fromkeys(_WORD.findall(text)):
            if word in _CTES and word not in ordered and word not in path:
                visit(_CTES[word], (*path, word))
                ordered.append(word)

    visit(sql, ())
    sql = sql.strip()
    if not ordered:
        return sql
    prefix = ",\n".join(f"{n} AS ({_CTES[n]})" for n in ordered)
    if sql[:5].upper() == "WITH ":
        return f"WITH {prefix},\n{sql[5:]}"
    return f"WITH {prefix}\n{sql}"


def oracle() -> dict[str, str]:
    return {q.name: assemble(q.sql) for q in QUERIES.values() if q.sql}
