"""Small helpers to declare queries beside their oracle SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.sources import table


class Tables:
    """Tables of a dataset folder as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)


class Catalogue:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def query(self, name: str, oracle: str | None = None):
        """Decorator of a function of Tables."""

        def add(f: Callable[[Tables], DataFrame]):
            self.queries[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
            if oracle is not None:
                self.oracle[name] = oracle
            return f

        return add

    def sql(self, name: str, text: str, oracle: str | None = None) -> None:
        """A Spark SQL query over {table} names; the oracle is the same text unless the
        dialects differ."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            names = set(re.findall(r"\{(\w+)\}", text))
            return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})

        self.queries[name] = run
        self.oracle[name] = re.sub(r"\{(\w+)\}", r"\1", oracle or text)
