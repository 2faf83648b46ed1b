"""Queries of the retrieval operators by name, with their SQL for DuckDB."""

from __future__ import annotations

from importlib import import_module

MODULES: tuple[str, ...] = ("scalar", "retrieval", "tables", "operations", "quality", "streams", "surface")


def queries() -> dict:
    return {k: v for m in MODULES for k, v in import_module(f"plinth.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in import_module(f"plinth.plans.{m}").SQL.items()}
