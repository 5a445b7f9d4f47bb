"""Query catalogue: every operator is registered with a Spark callable
``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, the DuckDB
oracle statement that must return the same rows."""

from __future__ import annotations

import functools
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        @functools.wraps(fn)
        def run(spark, sf_dir):
            from labelloop.session import ship_package
            ship_package(spark)
            return fn(spark, sf_dir)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every catalogue module so that its queries register."""
    import importlib
    for mod in ("q_retrieval", "q_vectors", "q_text", "q_labelling", "q_selection",
                "q_demos", "q_training", "q_sources", "q_streaming"):
        try:
            importlib.import_module(f"labelloop.plans.{mod}")
        except ModuleNotFoundError as e:
            if e.name != f"labelloop.plans.{mod}":
                raise
