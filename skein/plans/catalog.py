"""All core queries."""

from __future__ import annotations

import importlib

from skein.plans import registry

for _m in ("corpus_queries", "shard_queries", "vector_queries", "scalar_queries", "state_queries", "stream_queries"):
    try:
        importlib.import_module(f"skein.plans.{_m}")
    except ModuleNotFoundError as e:
        if e.name != f"skein.plans.{_m}":
            raise


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.ORACLE)
