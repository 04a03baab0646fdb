"""Every query of the crawl engine by name, and its SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ["audits", "reports", "frontiers", "pages", "telemetries", "streams"]

_modules = [import_module(f"sparkfrontier.plans.{name}") for name in MODULES]
QUERIES = {name: f for m in _modules for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _modules for name, sql in m.ORACLE_SQL.items()}
