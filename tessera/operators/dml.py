"""Table changes as rewrites: each returns the DataFrame of the table's next state,
which the caller writes as a new version (``save``).  Constraints are queries for
the rows that break them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.shared import new_path


def create(spark: SparkSession, schema: str | StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def save(df: DataFrame, tag: str = "table") -> DataFrame:
    """Write as a new version and read it back; older versions stay as they are."""
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_ids(df: DataFrame, *order: str, first: int = 1, name: str = "_id") -> DataFrame:
    """Consecutive row ids in the order given: a range sort, a count for each partition,
    and a place within it; no single task holds all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    from tessera.operators.shared import write_shared

    held = write_shared(ranged, "ids")
    counts = held.groupBy("_part").agg(F.count("*").alias("_n"))  # one row a partition
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    out = held.withColumn("_at", place).join(F.broadcast(starts), "_part")
    return out.withColumn(name, (F.col("_start") + F.col("_at") + first - 1).cast("long")).drop("_part", "_at", "_start")


def shaped(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows with the table's columns, by name; those they lack take their default or NULL."""
    for name, value in (defaults or {}).items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), value) if name in rows.columns else value)
    for field in table.schema:
        rows = rows.withColumn(field.name, (F.col(field.name) if field.name in rows.columns else F.lit(None)).cast(field.dataType))
    return rows.select(*table.columns)


def insert(table: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """Rows appended by name; columns they lack take their default or NULL."""
    return table.union(shaped(table, rows, defaults))


def overwrite_partition(table: DataFrame, rows: DataFrame, **partition: object) -> DataFrame:
    """INSERT OVERWRITE of one partition (of everything if none is named)."""
    keep = table.where("false")
    if partition:
        same = F.lit(True)
        for name, value in partition.items():
            same = same & F.col(name).eqNullSafe(F.lit(value))
            rows = rows.withColumn(name, F.lit(value))
        keep = table.where(~same)
    return insert(keep, rows)


def update(table: DataFrame, changes: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return table.select(*[F.when(hit, changes[f.name]).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) if f.name in changes else F.col(f.name) for f in table.schema])


def delete(table: DataFrame, where: Column) -> DataFrame:
    return table.where(~F.coalesce(where, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], do_update: Mapping[str, str] | None = None) -> DataFrame:
    """INSERT ... ON CONFLICT (keys): DO NOTHING, or with ``do_update`` DO UPDATE SET
    column = a column of the new row.  NULL keys never conflict; of new rows that share
    a key the greatest by their other columns, in order, is taken, whatever the run."""
    others = [c for c in rows.columns if c not in keys]
    known = rows.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys)))
    if others:
        one = known.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_one")).select(*[F.col(c) if c in keys else F.col(f"_one.{c}") for c in rows.columns])
    else:
        one = known.distinct()
    nulls = rows.where(F.expr(" OR ".join(f"{k} IS NULL" for k in keys)))
    fresh = one.join(table.select(*keys), list(keys), "left_anti").unionByName(nulls, allowMissingColumns=True)
    if not do_update:
        return insert(table, fresh)
    new = one.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[F.col(v).alias(f"_new_{c}") for c, v in do_update.items()], F.lit(True).alias("_hit"))
    on = [table[k] == new[f"_k_{k}"] for k in keys]
    met = table.join(new, on, "left")
    changed = met.select(*[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in do_update else F.col(c) for c in table.columns])
    return insert(changed, fresh)


def violations(df: DataFrame, *, not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), check: Mapping[str, Column] | None = None, references: Mapping[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(constraint, n): how many rows break each."""
    parts = [df.where(F.col(c).isNull()).agg(F.lit(f"NOT NULL {c}").alias("constraint"), F.count("*").alias("n")) for c in not_null]
    for keys in unique:
        own = df.where(F.expr(" AND ".join(f"{k} IS NOT NULL" for k in keys))).groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1")
        parts.append(own.agg(F.lit(f"UNIQUE {', '.join(keys)}").alias("constraint"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")))
    for name, rule in (check or {}).items():
        parts.append(df.where(~rule).agg(F.lit(f"CHECK {name}").alias("constraint"), F.count("*").alias("n")))
    for column, (parent, key) in (references or {}).items():
        lost = df.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")
        parts.append(lost.agg(F.lit(f"REFERENCES {column}").alias("constraint"), F.count("*").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def analyze(df: DataFrame) -> DataFrame:
    """(column, n, nulls, distinct, lowest, highest) in one pass over the table."""
    names = df.columns
    aggs = []
    for i, c in enumerate(names):
        aggs += [F.count_distinct(c).alias(f"d{i}"), F.count(F.when(F.col(c).isNull(), 1)).alias(f"u{i}"), F.min(c).cast("string").alias(f"l{i}"), F.max(c).cast("string").alias(f"h{i}")]
    row = df.agg(F.count("*").alias("n"), *aggs)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n"), F.col(f"u{i}").alias("nulls"), F.col(f"d{i}").alias("distinct"), F.col(f"l{i}").alias("lowest"), F.col(f"h{i}").alias("highest")) for i, c in enumerate(names)])
    return row.select(F.explode(each).alias("x")).select("x.*")


def table_info(df: DataFrame) -> DataFrame:
    rows = [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "cid int, name string, type string, nullable boolean")
