"""Sources and sinks, table changes, constraints, statistics, and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera import sources
from tessera.operators import dml
from tessera.operators.shared import new_path
from tessera.plans.declare import Catalogue, Tables
from tessera.streaming import events as S

C = Catalogue()

for _kind in ("csv", "tsv", "json", "parquet"):

    def _round_trip(t: Tables, kind=_kind):
        path = new_path(t.spark, f"copy.{kind}") + f".{kind}"
        own = t.customer.select("c_custkey", "c_name", "c_acctbal", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"))
        sources.write(own, path, kind)
        return sources.read(t.spark, path, schema=None if kind == "parquet" else own.schema).select(*own.columns)

    C.query(f"copy_{_kind}", "SELECT c_custkey, c_name, c_acctbal, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer")(_round_trip)


@C.query("copy_json_array", "SELECT n_nationkey, n_name FROM nation")
def json_array(t: Tables):
    """One JSON array of records, as a text file of one line."""
    path = new_path(t.spark, "array")
    whole = t.nation.agg(F.to_json(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name")))).alias("value"))
    whole.coalesce(1).write.text(path)
    return sources.read(t.spark, path, "json", schema="n_nationkey int, n_name string")


C.query("read_by_id", "SELECT * FROM orders WHERE o_orderkey IN (3, 5, 77)")(lambda t: sources.retrieve(t.orders, [3, 5, 77], "o_orderkey"))


@C.query("blob_range", "SELECT doc_id, substr(text, 6, 10) AS part, octet_length(encode(text)) AS size FROM documents WHERE lang = 'en'")
def blob_range(t: Tables):
    """The bytes that hold the ten characters after the first five."""
    offset, length = (F.octet_length(F.substring("text", at, n)) for at, n in ((1, 5), (6, 10)))
    part = F.decode(sources.blob_range("b", offset, length), "utf-8")
    return t.documents.where("lang = 'en'").withColumn("b", F.encode("text", "utf-8")).select("doc_id", part.alias("part"), F.octet_length("b").cast("long").alias("size"))


C.query("blob_range_bytes", "SELECT doc_id, substr(hex(encode(text)), 11, 20) AS part FROM documents")(
    lambda t: t.documents.withColumn("b", F.encode("text", "utf-8")).select("doc_id", F.hex(sources.blob_range("b", 5, 10)).alias("part"))
)


@C.query("dml_insert", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT 100 + r_regionkey, r_name, -1 FROM region")
def insert(t: Tables):
    rows = t.region.select((100 + F.col("r_regionkey")).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return dml.insert(t.nation, rows, {"n_regionkey": F.lit(-1)})


@C.query("dml_insert_default", "SELECT 1 AS id, 100 AS score UNION ALL SELECT 2, 7")
def insert_default(t: Tables):
    rows = t.spark.createDataFrame([(1, None), (2, 7)], "id int, score int")
    return dml.save(dml.insert(dml.create(t.spark, "id int, score int"), rows, {"score": F.lit(100)}))


@C.query("dml_overwrite_partition", "SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 200 + r_regionkey, r_name, 2 FROM region")
def overwrite(t: Tables):
    rows = t.region.select((200 + F.col("r_regionkey")).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    return dml.overwrite_partition(t.nation, rows, n_regionkey=2)


C.query("dml_update", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_acctbal < 0 THEN 'DEBT' ELSE c_mktsegment END AS c_mktsegment FROM customer")(
    lambda t: dml.update(t.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), {"c_acctbal": F.lit(0.0), "c_mktsegment": F.lit("DEBT")}, F.col("c_acctbal") < 0)
)
C.query("dml_delete", "SELECT * FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, false)")(lambda t: dml.delete(t.customer, F.nullif("c_nationkey", F.lit(3)) > 10))
_NEW = "SELECT n_nationkey + 20 AS n_nationkey, lower(n_name) AS n_name, n_regionkey FROM nation WHERE n_nationkey < 10"


def _new(t: Tables):
    return t.nation.where("n_nationkey < 10").select((F.col("n_nationkey") + 20).alias("n_nationkey"), F.lower("n_name").alias("n_name"), "n_regionkey")


C.query("dml_conflict_nothing", f"SELECT * FROM nation UNION ALL SELECT * FROM ({_NEW}) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)")(lambda t: dml.upsert(t.nation, _new(t), ["n_nationkey"]))
C.query(
    "dml_conflict_update",
    f"SELECT a.n_nationkey, coalesce(b.n_name, a.n_name) AS n_name, a.n_regionkey FROM nation a LEFT JOIN ({_NEW}) b USING (n_nationkey) UNION ALL SELECT * FROM ({_NEW}) WHERE n_nationkey NOT IN (SELECT n_nationkey FROM nation)",
)(lambda t: dml.upsert(t.nation, _new(t), ["n_nationkey"], {"n_name": "n_name"}))
C.query("dml_alter", "SELECT n_nationkey AS id, n_name, CAST(NULL AS BIGINT) AS extra FROM nation")(lambda t: t.nation.withColumnRenamed("n_nationkey", "id").withColumn("extra", F.lit(None).cast("long")).drop("n_regionkey"))
C.query("dml_truncate", "SELECT * FROM nation WHERE false")(lambda t: dml.create(t.spark, t.nation.schema))
C.query("row_ids", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS _id FROM orders")(lambda t: dml.with_ids(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey").select("o_orderkey", "_id"))


@C.query(
    "constraint_violations",
    """SELECT 'NOT NULL k' AS "constraint", (SELECT count(*) FROM customer WHERE c_nationkey = 3) AS n UNION ALL SELECT 'UNIQUE c_nationkey, c_mktsegment', (SELECT coalesce(sum(c), 0)::BIGINT FROM (SELECT count(*) AS c FROM customer GROUP BY c_nationkey, c_mktsegment) WHERE c > 1)
       UNION ALL SELECT 'CHECK rich', (SELECT count(*) FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'REFERENCES c_nationkey', (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20))""",
)
def violations(t: Tables):
    own = t.customer.withColumn("k", F.nullif("c_nationkey", F.lit(3)))
    return dml.violations(own, not_null=["k"], unique=[["c_nationkey", "c_mktsegment"]], check={"rich": F.col("c_acctbal") >= 0}, references={"c_nationkey": (t.nation.where("n_nationkey < 20"), "n_nationkey")})


C.query(
    "analyze",
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\", CAST(min({c}) AS VARCHAR) AS lowest, CAST(max({c}) AS VARCHAR) AS highest FROM nation" for c in ("n_nationkey", "n_name", "n_regionkey")),
)(lambda t: dml.analyze(t.nation))
C.query("table_info")(lambda t: dml.table_info(t.lineitem))


@C.query("explain")
def explain(t: Tables):
    """The formatted plan, a row a line."""
    text = t.spark.sql("EXPLAIN FORMATTED SELECT count(*) FROM {orders} WHERE o_totalprice > 100", orders=t.orders)
    return text.select(F.explode(F.split("plan", "\n")).alias("line"))


C.query(
    "stream_tumbling",
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
)(lambda t: S.tumbling_counts(t.spark, f"{t.sf_dir}/events.parquet", "1 hour"))

QUERIES, ORACLE = C.queries, C.oracle
