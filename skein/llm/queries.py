"""The queries of the training-data operators, gathered for the entry module."""

from __future__ import annotations

import importlib

MODULES = ("p1_forms", "p2_near", "p3_types", "p4_copies", "p5_overlap", "p6_unsafe", "p7_tokens", "p8_mix", "p9_sentences")


def _gather(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        try:
            out.update(getattr(importlib.import_module(f"skein.llm.{m}"), name, {}))
        except ModuleNotFoundError as e:
            if e.name != f"skein.llm.{m}":
                raise
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE")
