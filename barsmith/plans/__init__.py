"""Registered queries and their SQL."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("core", "trading", "attribution", "research", "datasets", "mining", "learning")


def queries() -> dict:
    for m in _MODULES:
        import_module(f"barsmith.plans.{m}")
    from barsmith.plans.core import QUERIES

    return QUERIES


def oracle_sql() -> dict[str, str]:
    queries()
    from barsmith.plans.core import SQL

    return SQL
