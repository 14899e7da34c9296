"""The query catalogue: each module has ``QUERIES`` and ``ORACLE``."""

from __future__ import annotations

import importlib

MODULES = ("basic", "joining", "grouping", "scalars", "search", "changes", "more")


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
