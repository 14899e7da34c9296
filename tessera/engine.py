"""A client over a SparkSession: named databases and tables, rows in and out, changes,
constraints, search.  Tables are external Parquet tables of the catalogue.  Appended rows
are added to the table's folder; any other change writes the table's next state to a new
folder and points the table at it, so that readers of the last state aren't disturbed.
What a table's constraints forbid isn't taken over, and its text indexes follow each
change; both are named in properties of the table.  One writer at a time is assumed.
SQL text goes to Spark as it is."""

from __future__ import annotations

import json
import re
import time
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera import sources
from tessera.operators import dml, fts, vector
from tessera.operators.shared import new_path, write_shared

#: A statement of a script: quoted parts and comments are passed over.
_STATEMENT = re.compile(r"""(?:'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|[^;])+""", re.DOTALL)
_COMMENT = re.compile(r"--[^\n]*|/\*.*?\*/", re.DOTALL)


class Engine:
    def __init__(self, spark: SparkSession, database: str = "default", key: str = "_id") -> None:
        self.spark, self.key = spark, key
        self.use_database(database)

    # Databases and tables

    def use_database(self, name: str) -> None:
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")
        self.spark.catalog.setCurrentDatabase(name)

    def list_databases(self) -> list[str]:
        return sorted(d.name for d in self.spark.catalog.listDatabases())

    def list_tables(self) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables())

    def table(self, name: str) -> DataFrame:
        return self.spark.table(name)

    def create_table(self, name: str, schema: str | StructType | None = None, rows: DataFrame | None = None) -> DataFrame:
        """An empty table of ``schema``, or one of ``rows``."""
        if self.spark.catalog.tableExists(name):
            raise ValueError(f"table {name} exists")
        return self._point(name, rows if rows is not None else dml.create(self.spark, schema))

    def _point(self, name: str, state: DataFrame) -> DataFrame:
        """Point the table at its next state, unless that breaks a constraint."""
        there = self.spark.catalog.tableExists(name)
        rules, indexed = (self._property(name, "rules"), self._property(name, "indexes")) if there else (None, None)
        path = new_path(self.spark, f"table-{name}")
        state.write.parquet(path)
        written = self.spark.read.schema(state.schema).parquet(path)
        self._check(name, written, rules)
        self._check_children(name, written)
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        self.spark.catalog.createTable(name, path, "parquet", state.schema)
        self._set_property(name, "rules", rules)
        self._set_property(name, "indexes", None)
        for text in indexed or []:
            if text in state.columns:
                self.build_index(name, text)
            else:
                self.spark.sql(f"DROP TABLE IF EXISTS `{self._index(name, text)}`")
        return self.table(name)

    def _append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add rows of the table's columns to its folder; nothing there is written again."""
        new = write_shared(rows, f"rows-{name}")
        if rules := self._property(name, "rules"):
            self._check(name, self.table(name).union(new), rules)
        new.write.insertInto(name)
        for text in self._property(name, "indexes") or []:
            fts.postings(new, self.key, text).write.insertInto(self._index(name, text))
        return self.table(name)

    def _property(self, name: str, key: str):
        found = {r["key"]: r["value"] for r in self.spark.sql(f"SHOW TBLPROPERTIES `{name}`").collect()}
        return json.loads(found[f"tessera.{key}"]) if f"tessera.{key}" in found else None

    def _set_property(self, name: str, key: str, value: object) -> None:
        if value:
            text = json.dumps(value).replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"ALTER TABLE `{name}` SET TBLPROPERTIES ('tessera.{key}' = '{text}')")
        else:
            self.spark.sql(f"ALTER TABLE `{name}` UNSET TBLPROPERTIES IF EXISTS ('tessera.{key}')")

    def drop_table(self, name: str) -> None:
        """The table with its text indexes."""
        if self.spark.catalog.tableExists(name):
            for text in self._property(name, "indexes") or []:
                self.spark.sql(f"DROP TABLE IF EXISTS `{self._index(name, text)}`")
        self.spark.sql(f"DROP TABLE IF EXISTS `{name}`")

    # Constraints

    def constrain(self, name: str, not_null: Sequence[str] = (), unique: Sequence[Sequence[str]] = (), check: Mapping[str, str] | None = None, references: Mapping[str, Sequence[str]] | None = None) -> None:
        """State the table's constraints in place of earlier ones; its rows must keep them, and
        so must each later state.  ``check`` names SQL conditions (NULL passes),
        ``references`` gives for a column the (table, column) that holds its values."""
        rules = {"not_null": list(not_null), "unique": [list(u) for u in unique], "check": dict(check or {}), "references": {c: list(r) for c, r in (references or {}).items()}}
        rules = {k: v for k, v in rules.items() if v}
        self._check(name, self.table(name), rules)
        self._set_property(name, "rules", rules)

    def constraints(self, name: str) -> dict:
        return self._property(name, "rules") or {}

    def violations(self, name: str, state: DataFrame, rules: Mapping) -> DataFrame:
        """(constraint, n) of a state under ``rules``."""
        check = {k: F.expr(v) for k, v in rules.get("check", {}).items()}
        # A table that refers to itself is judged by its own next state.
        parents = {c: (state if parent == name else self.table(parent), key) for c, (parent, key) in rules.get("references", {}).items()}
        return dml.violations(state, not_null=rules.get("not_null", ()), unique=rules.get("unique", ()), check=check, references=parents)

    def _check(self, name: str, state: DataFrame, rules: Mapping | None) -> None:
        if rules:
            broken = {r["constraint"]: r.n for r in self.violations(name, state, rules).where("n > 0").collect()}
            if broken:
                raise ValueError(f"table {name}: rows that break constraints: {broken}")

    def _check_children(self, name: str, state: DataFrame) -> None:
        """The next state must hold all that other tables refer to."""
        for child in self.list_tables():
            if child == name or self.spark.catalog.getTable(child).tableType not in ("EXTERNAL", "MANAGED"):
                continue
            for column, (parent, key) in (self._property(child, "rules") or {}).get("references", {}).items():
                if parent == name:
                    own = self.table(child)
                    lost = dml.violations(own, references={column: (state, key)}).where("n > 0").collect()
                    if lost:
                        raise ValueError(f"table {child}: {lost[0].n} rows would lose what {column} refers to")

    def truncate(self, name: str) -> DataFrame:
        return self._point(name, self.table(name).limit(0))

    def register_temp_table(self, name: str, path: str, **options) -> DataFrame:
        df = sources.read(self.spark, path, **options)
        df.createOrReplaceTempView(name)
        return df

    def drop_temp_table(self, name: str) -> None:
        self.spark.catalog.dropTempView(name)

    # Columns

    def fields(self, name: str) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.table(name).schema}

    def add_column(self, name: str, column: str, kind: str) -> DataFrame:
        return self._point(name, self.table(name).withColumn(column, F.lit(None).cast(kind)))

    def drop_column(self, name: str, column: str) -> DataFrame:
        return self._point(name, self.table(name).drop(column))

    def rename_column(self, name: str, old: str, new: str) -> DataFrame:
        return self._point(name, self.table(name).withColumnRenamed(old, new))

    # Rows

    def store(self, name: str, rows: Iterable[Mapping] | DataFrame) -> DataFrame:
        """Append rows (dicts, or a DataFrame of any size); rows without the key get the
        next ids; new columns are added; a new table is made if there is none."""
        new = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame([dict(r) for r in rows])
        there = self.spark.catalog.tableExists(name)
        if there:
            own = self.table(name)
            for f in new.schema:
                if f.name not in own.columns:
                    own = own.withColumn(f.name, F.lit(None).cast(f.dataType))
        else:
            own = dml.create(self.spark, new.schema if self.key in new.columns else StructType(list(new.schema)).add(self.key, "long"))
        if self.key not in new.columns:
            last = own.agg(F.max(self.key)).first()[0] if self.key in own.columns else None
            new = dml.with_ids(new, *new.columns, first=(last or 0) + 1, name=self.key)
        if there and own.columns == self.table(name).columns:
            return self._append(name, dml.shaped(own, new))
        return self._point(name, dml.insert(own, new))

    def from_pandas(self, name: str, frame) -> DataFrame:
        """Append a pandas frame, which the driver holds, or an Arrow table."""
        return self.store(name, self.spark.createDataFrame(frame))

    def retrieve(self, name: str, ids: Sequence) -> DataFrame:
        return sources.retrieve(self.table(name), list(ids), self.key)

    def count_rows(self, name: str) -> int:
        return self.table(name).count()

    def update(self, name: str, changes: Mapping[str, Column], where: Column | None = None) -> DataFrame:
        return self._point(name, dml.update(self.table(name), changes, where))

    def delete(self, name: str, where: Column) -> DataFrame:
        return self._point(name, dml.delete(self.table(name), where))

    def delete_ids(self, name: str, ids: Sequence | DataFrame) -> DataFrame:
        """Rows of these keys: a list, or a DataFrame of one column of any size."""
        if isinstance(ids, DataFrame):
            gone = ids.select(F.col(ids.columns[0]).alias(self.key))
            return self._point(name, self.table(name).join(gone, self.key, "left_anti").select(*self.table(name).columns))
        return self.delete(name, F.col(self.key).isin(list(ids)))

    def replace(self, name: str, rows: DataFrame) -> DataFrame:
        """Rows by key: what is there is overwritten, the rest appended."""
        own = self.table(name)
        changes = {c: c for c in rows.columns if c != self.key and c in own.columns}
        return self._point(name, dml.upsert(own, rows, [self.key], changes))

    # Queries and search

    def execute(self, text: str, **frames: DataFrame) -> DataFrame:
        return self.spark.sql(text, **frames)

    def execute_batch(self, texts: Sequence[str]) -> list[DataFrame]:
        """One statement after another."""
        return [self.spark.sql(t) for t in texts]

    def execute_script(self, text: str) -> DataFrame | None:
        """Statements parted by semicolons (none inside quotes or comments); the result of
        the last one, None for an empty script."""
        found = self.execute_batch([t for t in _STATEMENT.findall(text) if _COMMENT.sub("", t).strip()])
        return found[-1] if found else None

    def set_variable(self, name: str, value: object) -> None:
        """A session variable, which SQL text reads by its name."""
        self.spark.sql(f"DECLARE OR REPLACE VARIABLE `{name}` DEFAULT :value", args={"value": value})

    def reset_variable(self, name: str) -> None:
        self.spark.sql(f"DROP TEMPORARY VARIABLE IF EXISTS `{name}`")

    def create_view(self, name: str, text: str) -> DataFrame:
        """A view that the catalogue keeps."""
        self.spark.sql(f"CREATE OR REPLACE VIEW `{name}` AS {text}")
        return self.table(name)

    def drop_view(self, name: str) -> None:
        self.spark.sql(f"DROP VIEW IF EXISTS `{name}`")

    def explain(self, text: str, analyze: bool = False) -> str:
        """The formatted plan; with ``analyze`` the query runs and its seconds follow."""
        plan = self.spark.sql(f"EXPLAIN FORMATTED {text}").first().plan
        if analyze:
            began = time.perf_counter()
            self.spark.sql(text).write.format("noop").mode("overwrite").save()
            plan += f"\nseconds: {time.perf_counter() - began:.3f}"
        return plan

    def stats(self, name: str) -> DataFrame:
        return dml.analyze(self.table(name))

    def integrity_check(self, name: str) -> DataFrame:
        """(constraint, n): the table's constraints and how many rows break each."""
        rules = self.constraints(name)
        if not rules:
            return self.spark.createDataFrame([], "constraint string, n long")
        return self.violations(name, self.table(name), rules)

    @staticmethod
    def _index(name: str, text: str) -> str:
        return f"{name}_{text}_fts"

    def build_index(self, name: str, text: str) -> DataFrame:
        """Write the postings of a text column as a table, name_text_fts, which follows the
        table's changes."""
        found = self._point(self._index(name, text), fts.postings(self.table(name), self.key, text))
        self._set_property(name, "indexes", sorted({*self.list_indexes(name), text}))
        return found

    def list_indexes(self, name: str) -> list[str]:
        return self._property(name, "indexes") or []

    def drop_index(self, name: str, text: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS `{self._index(name, text)}`")
        self._set_property(name, "indexes", [t for t in self.list_indexes(name) if t != text])

    def index_stats(self, name: str, text: str) -> DataFrame:
        return fts.stats(self.table(self._index(name, text)))

    def search_text(self, name: str, text: str, query: str, fuzzy: bool = False) -> DataFrame:
        """Rows whose text matches, by the index built before."""
        index = self.table(self._index(name, text))
        found = (fts.fuzzy_match if fuzzy else fts.match)(index, query)
        return self.table(name).join(found, F.col(self.key) == F.col("doc"), "left_semi")

    def search_ranked(self, name: str, text: str, query: str, n: int) -> DataFrame:
        """The n rows of the best ``score`` (BM25) that hold any of the terms; ties by key."""
        own = self.table(name)
        index = self.table(self._index(name, text))
        scores = fts.bm25(index, fts.held_lengths(index), query)
        best = scores.orderBy(F.desc("score"), "doc").limit(n)
        return own.join(best, F.col(self.key) == F.col("doc")).drop("doc").orderBy(F.desc("score"), self.key)

    def top_k(self, name: str, column: str, query: Sequence[float], k: int, metric: str = "l2") -> DataFrame:
        return vector.top_k(self.table(name), column, query, k, metric, self.key)

    def batch_top_k(self, name: str, column: str, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
        """(query_id, key, dist) of the k nearest of each of ``queries`` (query_id, query)."""
        return vector.batch_top_k(self.table(name), column, self.key, queries, k, metric)

    def copy_to(self, name: str, path: str, kind: str = "parquet", **options) -> None:
        sources.write(self.table(name), path, kind, **options)

    def copy_from(self, name: str, path: str, kind: str | None = None, **options) -> DataFrame:
        return self.store(name, sources.read(self.spark, path, kind, **options))
