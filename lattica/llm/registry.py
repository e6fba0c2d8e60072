"""The queries of this subpackage and the SQL for those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil

import lattica.llm


def modules() -> list:
    names = sorted(m.name for m in pkgutil.iter_modules(lattica.llm.__path__) if m.name.startswith("op"))
    return [importlib.import_module(f"lattica.llm.{n}") for n in names]


def queries() -> dict:
    return {k: f for m in modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in modules() for k, s in m.ORACLE_SQL.items()}
