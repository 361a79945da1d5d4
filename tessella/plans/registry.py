"""Registry of runnable queries, each with an independent DuckDB statement where one exists."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FRAGMENTS: dict[str, tuple[tuple[str, ...], str]] = {}

MODULES = (
    "derived", "q_sources", "q_structure", "q_segment", "q_dedup", "q_enrich", "q_units", "q_graph",
    "q_lifecycle", "q_catalog", "q_understanding", "q_retrieval", "q_fusion", "q_context",
    "q_evaluation", "q_streaming",
)


def fragment(name: str, sql: str, needs: tuple[str, ...] = ()) -> None:
    """Declare a named CTE that oracle statements may build on."""
    FRAGMENTS[name] = (needs, sql)


def _ordered(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        needs, _ = FRAGMENTS[name]
        _ordered(needs, seen)
        if name not in seen:
            seen.append(name)
    return seen


def with_fragments(sql: str, needs: tuple[str, ...]) -> str:
    sql = sql.strip()
    heads = [f"{n} AS ({FRAGMENTS[n][1].strip()})" for n in _ordered(needs, [])]
    if not heads:
        return sql
    if sql[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(heads) + ",\n" + sql[5:]
    return "WITH " + ",\n".join(heads) + "\n" + sql


def query(name: str, sql: str | None = None, needs: tuple[str, ...] = ()):
    """Register a query; ``sql`` is its oracle and ``needs`` the CTEs the oracle builds on."""

    def keep(fn: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fragments(sql, needs)
        return fn

    return keep


def load_all() -> None:
    for module in MODULES:
        import_module(f"tessella.plans.{module}")
