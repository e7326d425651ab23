"""Registry of queries and the composition of their check SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Run = Callable[[SparkSession, str], DataFrame]

MODULES = (
    "sources",
    "predicates",
    "calendar",
    "alignment",
    "indicators",
    "fundamentals",
    "joins",
    "cross_section",
    "walk_forward",
    "forecasts",
    "sizing",
    "portfolio",
    "metrics",
    "sweeps",
    "sensitivity",
    "alphas",
    "studies",
)


@dataclass(frozen=True)
class Query:
    name: str
    run: Run
    sql: str | None


REGISTRY: dict[str, Query] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def register(run: Run) -> Run:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, run, sql)
        return run

    return register


def cte(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    """Name a shared table expression of the check SQL."""
    if name in CTES:
        raise ValueError(f"duplicate table expression {name}")
    CTES[name] = (uses, sql)


def check_sql(body: str, *uses: str) -> str:
    """``body`` preceded by the table expressions it needs, dependencies first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dependency in CTES[name][0]:
            visit(dependency)
        order.append(name)

    for name in uses:
        visit(name)
    if not order:
        return body
    parts = [f"{name} AS ({CTES[name][1]})" for name in order]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def load_all() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"panelworks.catalog.{module}")
    return REGISTRY
