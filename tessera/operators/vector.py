"""Vector distances and nearest neighbours over array<float> columns.

Distances are JVM expressions in double precision, in batches the same sums in numpy.  A vector of another dimension
than the query's, or a NULL one, gives NULL and is no neighbour.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from tessera.operators.nearest import nearest

#: Queries of a block, rows of a part, and numbers held in either at most.
QUERY_BLOCK, ROW_PART, VALUES = 4096, 16384, 1 << 21
#: Parts at least, so that a small table has several tasks.
PARTS = 8


def literal(query: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in query])


def _sum(a: Column, b: Column, term) -> Column:
    terms = F.zip_with(a, b, lambda x, y: term(x.cast("double"), y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.aggregate(terms, F.lit(0.0), lambda s, t: s + t))


def l2_squared(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: (x - y) * (x - y))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(l2_squared(a, b))


def l1(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: F.abs(x - y))


def linf(a: Column, b: Column) -> Column:
    terms = F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.array_max(terms))


def inner_product(a: Column, b: Column) -> Column:
    return _sum(a, b, lambda x, y: x * y)


def negative_inner_product(a: Column, b: Column) -> Column:
    return -inner_product(a, b)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(F.transform(a, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda s, t: s + t))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for a zero vector."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0) * inner_product(a, b)).otherwise(inner_product(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def dimension(a: Column) -> Column:
    return F.size(a)


def to_text(a: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(a.cast("array<string>"), ", "), F.lit("]"))


METRICS = {
    "l2": l2, "euclidean": l2, "l2_squared": l2_squared, "l1": l1, "manhattan": l1, "linf": linf, "chebyshev": linf,
    "cosine": cosine_distance, "cosine_distance": cosine_distance, "dot": negative_inner_product, "inner_product": negative_inner_product,
}


def top_k(df: DataFrame, column: str, query: Sequence[float], k: int, metric: str = "l2", key: str | None = None) -> DataFrame:
    """The k nearest rows with their ``dist``; ties by ``key``.  A heap in each task, then
    one of all (TakeOrderedAndProject)."""
    found = df.withColumn("dist", METRICS[metric](F.col(column), literal(query))).where("dist IS NOT NULL")
    return found.orderBy("dist", *([key] if key else [])).limit(k)


def _held(df: DataFrame, column: str, name: str, holes: bool) -> DataFrame:
    """The vector under another name, and its dimension; one with a NULL in it stays only
    for metrics that skip NULLs."""
    own = F.col(column) if df.schema[column].dataType == ArrayType(FloatType(), df.schema[column].dataType.containsNull) else F.col(column).cast("array<double>")
    return df.withColumn(name, own).withColumn("_dim", F.size(name)).where(F.col(name).isNotNull() & (F.lit(holes) | ~F.exists(name, lambda x: x.isNull()))).drop(column)


def _places(df: DataFrame, size: int, least: int = 1) -> int:
    """How many places hold about ``size`` rows each, fewer if they are wide."""
    n, wide = df.agg(F.count("*"), F.max("_dim")).first()
    return max(least, math.ceil(n / max(1, min(size, VALUES // max(1, wide or 1)))))


def batch_top_k(df: DataFrame, column: str, key: str, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """(query_id, key, dist): the k nearest of each row of ``queries`` (query_id, query).

    A stated query set against all rows, each pair of them compared.  Rows are dealt into
    parts and queries into blocks by hashes; a part, a block and a dimension make a group
    of bounded size, and the k nearest of each group are ranked.  The rows are shuffled
    once for each block and the queries once for each part; nothing is held whole, and the
    plan doesn't grow with the queries.
    """
    holes = metric in ("linf", "chebyshev")
    rows, asked = _held(df.select(key, column), column, "_v", holes), _held(queries.select("query_id", "query"), "query", "_q", holes)
    parts, blocks = _places(rows, ROW_PART, PARTS), _places(asked, QUERY_BLOCK)
    place = lambda n, *by: F.pmod(F.xxhash64(*by), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cell = ["_dim", "_part", "_block"]
    own = rows.withColumn("_part", place(parts, key, "_v")).withColumn("_block", each(blocks)).groupBy(*cell)
    met = own.cogroup(asked.withColumn("_block", place(blocks, "query_id", "_q")).withColumn("_part", each(parts)).groupBy(*cell))
    schema = StructType([StructField("query_id", asked.schema["query_id"].dataType), StructField(key, rows.schema[key].dataType), StructField("dist", DoubleType())])
    found = met.applyInArrow(partial(nearest, key=key, k=k, metric=metric), schema)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("dist", key))
    return found.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
