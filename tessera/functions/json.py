"""JSON text functions.  Reading and building stay in the JVM; changing a value
inside a text has no built-in and runs as an Arrow-batched function."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(c: Column, path: str) -> Column:
    return F.get_json_object(c, path)


def json_type(c: Column) -> Column:
    """Kind by the first character; SQL NULL counts as JSON null."""
    s = F.trim(F.coalesce(c, F.lit("null")))
    first = F.substring(s, 1, 1)
    number = F.when(s.rlike("[.eE]"), "REAL").otherwise("INTEGER")
    return (
        F.when(first == "{", "OBJECT").when(first == "[", "ARRAY").when(first == '"', "STRING")
        .when(first.isin("t", "f"), "BOOLEAN").when(first == "n", "NULL").otherwise(number)
    )


def valid(c: Column) -> Column:
    """1 or 0; NULL is 0."""
    return F.when(F.try_parse_json(c).isNotNull(), 1).otherwise(0)


def array_length(c: Column, path: str = "$") -> Column:
    """Of the array at ``path``; 0 for what is no array."""
    if path != "$":
        return F.when(c.isNotNull(), F.coalesce(F.json_array_length(F.get_json_object(c, path)), F.lit(0)))
    return F.when(c.isNotNull(), F.coalesce(F.json_array_length(c), F.lit(0)))


def object_(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in pairs]), {"ignoreNullFields": "false"})


def array(*values: Column) -> Column:
    return F.to_json(F.array(*values), {"ignoreNullFields": "false"})


def _steps(path: str) -> list[str | int]:
    return [int(i) if i else k for k, i in re.findall(r"\.([^.\[\]]+)|\[(\d+)\]", path)]


def _changed(text: str | None, steps: list[str | int], value: object, mode: str) -> str | None:
    if text is None:
        return None
    try:
        whole = json.loads(text)
    except ValueError:
        return None
    at = whole
    for step in steps[:-1]:
        try:
            at = at[step]
        except (KeyError, IndexError, TypeError):
            return json.dumps(whole, separators=(",", ":"), ensure_ascii=False)
    last = steps[-1]
    is_list = isinstance(at, list) and isinstance(last, int)
    there = (isinstance(at, dict) and last in at) or (is_list and last < len(at))
    if mode == "remove":
        if there:
            del at[last]
    elif there and mode in ("set", "replace"):
        at[last] = value
    elif not there and mode in ("set", "insert"):
        if isinstance(at, dict):
            at[last] = value
        elif is_list:
            at.append(value)
    return json.dumps(whole, separators=(",", ":"), ensure_ascii=False)


def _change(c: Column, path: str, value: object, mode: str) -> Column:
    steps = _steps(path)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _changed(t, steps, value, mode))

    return run(c)


def set_(c: Column, path: str, value: object) -> Column:
    """Put ``value`` at ``path``, there or not."""
    return _change(c, path, value, "set")


def insert(c: Column, path: str, value: object) -> Column:
    return _change(c, path, value, "insert")


def replace(c: Column, path: str, value: object) -> Column:
    return _change(c, path, value, "replace")


def remove(c: Column, path: str) -> Column:
    return _change(c, path, None, "remove")
