"""The training-data queries by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

MODULES = ["mixing", "sharding", "rules", "toxicity", "quality", "html", "chosen_path", "substrings", "decontamination", "pii"]

_modules = [import_module(f"sparkfrontier.llm.{name}") for name in MODULES]
QUERIES = {name: f for m in _modules for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _modules for name, sql in m.ORACLE_SQL.items()}
