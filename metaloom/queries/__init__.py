"""Queries over the driver's tables, by name, with the SQL that says the same."""

from __future__ import annotations

import importlib
from types import ModuleType


def modules() -> list[ModuleType]:
    """The modules with QUERIES and SQL."""
    return [importlib.import_module(f"metaloom.queries.{n}") for n in ("problems", "relational", "metadata", "retrieval", "quality")]
