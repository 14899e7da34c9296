"""Remaining rows of the inventory: direct files, frames in and out, several writes from
one source, correlated IN, scripts through the client."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera import sources
from tessera.engine import Engine
from tessera.operators import dml
from tessera.plans.declare import Catalogue, Tables

C = Catalogue()

C.query("read_direct_file", "SELECT * FROM region")(lambda t: sources.read(t.spark, f"{t.sf_dir}/region.parquet"))
C.query("frames_in_and_out", "SELECT n_nationkey, upper(n_name) AS n_name FROM nation")(
    lambda t: t.spark.createDataFrame(t.nation.select("n_nationkey", F.upper("n_name").alias("n_name")).toArrow())
)
C.query("blob_info", "SELECT doc_id, octet_length(encode(text)) AS size, md5(text) AS digest FROM documents")(
    lambda t: t.documents.withColumn("b", F.encode("text", "utf-8")).select("doc_id", F.octet_length("b").cast("long").alias("size"), F.md5("b").alias("digest"))
)
C.sql("where_in_correlated", "SELECT o_orderkey FROM {orders} o WHERE o_orderstatus IN (SELECT l_linestatus FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
C.sql("case_in_aggregate_family", "SELECT l_shipdate IS NULL AS unknown, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM {lineitem} GROUP BY 1", "SELECT l_shipdate IS NULL AS unknown, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_returnflag = 'N') AS n, count(*) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1")
C.sql("window_named_twice", "SELECT event_id, row_number() OVER w AS rn, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 3) AS running FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")


@C.query("dml_multi_write", "SELECT 'big' AS part, o_orderkey FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT 'late', o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def multi_write(t: Tables):
    """One scan, rows dealt to several targets as partitions of one write."""
    targets = F.array_compact(F.array(F.when(F.col("o_totalprice") > 200000, F.lit("big")), F.when(F.col("o_orderdate") >= F.lit("1997-01-01").cast("timestamp_ntz"), F.lit("late"))))
    rows = t.orders.select("o_orderkey", F.explode(targets).alias("part"))
    return dml.save(rows, "multi").select("part", "o_orderkey")


@C.query("session_variable", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000")
def session_variable(t: Tables):
    """Set, read in SQL and reset."""
    engine, name = Engine(t.spark), f"least_{uuid.uuid4().hex[:12]}"
    engine.set_variable(name, 100000)
    engine.set_variable(name, 150000)
    found = dml.save(engine.execute(f"SELECT o_orderkey, o_totalprice FROM {{orders}} WHERE o_totalprice > {name}", orders=t.orders), "variable")
    engine.reset_variable(name)
    return found


@C.query(
    "engine_script",
    """SELECT r_regionkey AS k, CASE WHEN r_regionkey = 1 THEN 'CHANGED' ELSE r_name END AS name FROM region WHERE r_regionkey <> 4 UNION ALL SELECT 10, 'NEW'""",
)
def engine_script(t: Tables):
    """Create, insert, update, delete and upsert through the client."""
    engine, name = Engine(t.spark, key="k"), f"script_{uuid.uuid4().hex[:12]}"
    engine.create_table(name, "k int, name string")
    engine.store(name, t.region.select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))
    engine.update(name, {"name": F.lit("CHANGED")}, F.col("k") == 1)
    engine.delete(name, F.col("k") == 4)
    engine.replace(name, t.spark.createDataFrame([(10, "NEW")], "k int, name string"))
    out = dml.save(engine.table(name), "script")
    engine.drop_table(name)
    return out


QUERIES, ORACLE = C.queries, C.oracle
