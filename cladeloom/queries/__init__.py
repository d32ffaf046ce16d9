"""Registered queries: every one reads the given tables whole."""

from __future__ import annotations

import importlib

from cladeloom.queries.base import Query
from cladeloom.session import ship_package

MODULES = ["patterns", "models", "trees", "likelihood", "names", "files", "sampling"]


def registry() -> dict[str, Query]:
    found: dict[str, Query] = {}
    for name in MODULES:
        found.update(importlib.import_module(f"cladeloom.queries.{name}").QUERIES)
    return {name: Query(_shipped(q.run), q.sql) for name, q in found.items()}


def _shipped(run):
    def with_package(spark, sf_dir):
        ship_package(spark)
        return run(spark, sf_dir)

    return with_package
