"""Every query of the library by name, and the SQL that it is checked against."""

from __future__ import annotations

from importlib import import_module

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _part in ("retrieval", "relational", "state", "text", "cards", "nested", "extensions"):
    _module = import_module(f"tessellar.plans.{_part}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
