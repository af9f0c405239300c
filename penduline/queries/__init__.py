"""Queries by name, each with its SQL twin where there is one."""

from __future__ import annotations

import importlib

MODULES = ("evaluation", "planning", "validation", "series", "shapes", "scalars", "scoring", "etl", "prompts", "audits", "evaluators", "sources")


def load() -> tuple[dict, dict]:
    """(queries, SQL twins) of all modules but those of the training-data problems."""
    from penduline.queries import registry

    for name in MODULES:
        importlib.import_module(f"penduline.queries.{name}")
    return registry.QUERIES, registry.SQL
