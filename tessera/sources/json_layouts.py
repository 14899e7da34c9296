"""Whole-file JSON layouts of data frames: split, columns and index.  A file is one
document, read by one task; the files of a folder are read side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read(spark: SparkSession, path: str, layout: str, schema: str | StructType) -> DataFrame:
    """Rows of ``schema`` from files of a layout; cells that are missing are NULL.

    split: {"columns": [..], "index": [..], "data": [[..], ..]}
    columns: {column: {row: value}}
    index: {row: {column: value}}
    """
    own = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema
    whole = spark.read.text(path, wholetext=True)
    if layout == "split":
        parsed = whole.select(F.from_json("value", "columns array<string>, data array<array<string>>").alias("x"))
        rows = parsed.select(F.col("x.columns").alias("names"), F.explode("x.data").alias("cells"))
        cell = lambda name: F.get("cells", F.array_position("names", F.lit(name)).cast("int") - 1)
    elif layout == "index":
        parsed = whole.select(F.from_json("value", "map<string,map<string,string>>").alias("x"))
        rows = parsed.select(F.explode("x").alias("row", "cells"))
        cell = lambda name: F.try_element_at("cells", F.lit(name))
    elif layout == "columns":
        parsed = whole.select(F.from_json("value", "map<string,map<string,string>>").alias("x"))
        keys = F.array_distinct(F.flatten(F.transform(F.map_values("x"), lambda m: F.map_keys(m))))
        rows = parsed.select("x", F.explode(keys).alias("row"))
        cell = lambda name: F.try_element_at(F.try_element_at("x", F.lit(name)), F.col("row"))
    else:
        raise ValueError(layout)
    return rows.select(*[cell(f.name).cast(f.dataType).alias(f.name) for f in own])
