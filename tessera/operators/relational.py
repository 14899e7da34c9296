"""Operators that Spark's own API lacks a single call for."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.shared import write_shared


def exclude(df: DataFrame, *names: str) -> DataFrame:
    """All columns but these, which must be there."""
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*names)


def replace(df: DataFrame, **columns: Column) -> DataFrame:
    """All columns, some replaced in place."""
    missing = set(columns) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in df.columns])


def columns_like(df: DataFrame, pattern: str) -> DataFrame:
    """Columns whose name the pattern matches anywhere."""
    return df.select(*[c for c in df.columns if re.search(pattern, c)])


def distinct_on(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key by ``order``; Spark cuts the ranking before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def top_per_group(df: DataFrame, keys: Sequence[str], k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def exact_percentile(df: DataFrame, keys: Sequence[str], value: str, p: float, accuracy: int = 10_000) -> DataFrame:
    """keys and ``percentile``: the value of rank round((n - 1) * p) from 0, NULLs aside.

    A sketch brackets the answer; only rows inside the bracket, some thousandths of a
    group, are sorted, so that no group has to fit a task.  Groups of a few thousand
    rows, where a bracket is narrower than a few ranks, are sorted whole.
    """
    slack = 10 / accuracy
    rows = df.where(F.col(value).isNotNull())
    ends = F.percentile_approx(value, F.array(F.lit(max(0.0, p - slack)), F.lit(min(1.0, p + slack))), accuracy)
    few = F.col("_n") < 4 / slack
    # groupBy() without keys and a join on none: a constant key serves both.
    names = list(keys)
    if not names:
        rows, names = rows.withColumn("_all", F.lit(1)), ["_all"]
    stats = rows.groupBy(*names).agg(F.count("*").alias("_n"), ends.alias("_ends"), F.min(value).alias("_min"), F.max(value).alias("_max"))
    stats = stats.select(*names, F.floor((F.col("_n") - 1) * p + 0.5).alias("_rank"), F.when(few, F.col("_min")).otherwise(F.col("_ends")[0]).alias("_lo"), F.when(few, F.col("_max")).otherwise(F.col("_ends")[1]).alias("_hi"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"s.{k}")) for k in names]
    met = rows.select(*names, F.col(value).alias("_v")).alias("r").join(stats.alias("s"), on=[c for c in same]).select(*[F.col(f"r.{k}").alias(k) for k in names], "_v", "_lo", "_hi", "_rank")
    low = met.groupBy(*names).agg(F.count(F.when(F.col("_v") < F.col("_lo"), 1)).alias("_below"))
    near = met.where(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    near = near.withColumn("_at", F.row_number().over(Window.partitionBy(*names).orderBy("_v")) - 1)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in names]
    out = near.alias("a").join(low.alias("b"), on=[c for c in same]).where(F.col("_at") + F.col("_below") == F.col("_rank"))
    return out.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.col("_v").alias("percentile"))


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows of both with low <= point < high, by equi-join on bins of ``width``: a range
    is posted under each bin it meets, a point under its own.  Choose the width near
    the usual length of a range; the result is exact for any."""
    bin_of = lambda c: F.floor(c / width)
    posted = ranges.withColumn("_bin", F.explode(F.sequence(bin_of(F.col(low)), bin_of(F.col(high)))))
    met = points.withColumn("_bin", bin_of(F.col(point))).join(posted, "_bin")
    return met.where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bin")


def closure(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """All (src, dst) with a path from src to dst: recursion with distinct rows, so that
    cycles end.  Each round joins only what the last one found, and is written, which
    cuts the lineage."""
    edges = edges.select("src", "dst").distinct()
    found = fresh = write_shared(edges, "closure")
    for _ in range(most_rounds):
        step = fresh.join(edges.select(F.col("src").alias("dst"), F.col("dst").alias("_next")), "dst").select("src", F.col("_next").alias("dst")).distinct()
        fresh = write_shared(step.join(found, ["src", "dst"], "left_anti"), "closure")
        if not fresh.take(1):
            return found
        found = found.union(fresh)
    raise RuntimeError(f"no end after {most_rounds} rounds")


def salted_join(left: DataFrame, right: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join in which each key's left rows go to ``salts`` partitions, the right
    rows to all of them; for left sides with hot keys (inner, left, semi, anti).  The salt
    is a hash of the whole left row, the same when a lost task runs again."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    many = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    each = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return many.join(each, [key, "_salt"], how).drop("_salt")
