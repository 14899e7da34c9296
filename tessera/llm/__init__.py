"""Operators for training-data pipelines, one module each.

A module has ``QUERIES`` (name: function of spark and sf_dir) and ``ORACLE``
(name: DuckDB SQL), the latter empty where SQL can't express the operator.
"""

from __future__ import annotations

import importlib

MODULES = (
    "lm_scoring",
    "html_text",
    "quality_cnn",
    "language_id",
    "pii",
    "near_dedup",
    "bpe",
    "secrets",
    "quality_rules",
    "decontaminate",
)


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        out |= getattr(importlib.import_module(f"{__name__}.{module}"), name)
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("ORACLE")
