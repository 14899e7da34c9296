"""Joins, generators, set operations, common table expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.declare import Catalogue, Tables

C = Catalogue()

C.sql(
    "join_revenue_by_nation",
    """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
       FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON o_orderkey = l_orderkey
            JOIN {supplier} ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey JOIN {nation} ON n_nationkey = s_nationkey
            JOIN {region} ON r_regionkey = n_regionkey
       WHERE o_orderdate >= TIMESTAMP '1994-01-01' GROUP BY n_name""",
)
C.sql("join_inner_extra", "SELECT o_orderkey, l_linenumber FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey AND l_quantity * 4000 > o_totalprice")
C.sql("join_left_on", "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 250000")
C.sql("join_right", "SELECT o_orderkey, c_custkey FROM {orders} RIGHT JOIN {customer} ON c_custkey = o_custkey AND o_orderstatus = 'P'")
C.sql("join_full", "SELECT s.k AS s_k, c.k AS c_k, s.n AS s_n, c.n AS c_n FROM (SELECT s_nationkey AS k, count(*) AS n FROM {supplier} WHERE s_acctbal > 5000 GROUP BY 1) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM {customer} WHERE c_acctbal < -900 GROUP BY 1) c ON s.k = c.k")
C.sql("join_cross", "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}")
C.query("join_semi", "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")(
    lambda t: t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
)
C.query("join_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")(
    lambda t: t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
)
C.query("join_null_keys", "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a LEFT JOIN nation b ON nullif(a.n_regionkey, 1) = b.n_nationkey")(
    lambda t: t.nation.select(F.col("n_nationkey").alias("a"), F.nullif("n_regionkey", F.lit(1)).alias("k")).join(t.nation.select(F.col("n_nationkey").alias("b")), F.col("k") == F.col("b"), "left").select("a", "b")
)
C.sql("join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
C.sql("join_self", "SELECT a.n_name, b.n_name AS other FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
C.sql("join_subquery_top", "SELECT c_name, o_totalprice FROM (SELECT o_custkey, o_totalprice, o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 10) t JOIN {customer} ON c_custkey = o_custkey")
C.sql("join_using", "SELECT o_custkey, a.n AS all_, b.n AS big FROM (SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY 1) a LEFT JOIN (SELECT o_custkey, count(*) AS n FROM {orders} WHERE o_totalprice > 200000 GROUP BY 1) b USING (o_custkey)")


@C.query(
    "join_range_bands",
    """SELECT p_partkey, band FROM part JOIN (SELECT r_regionkey AS band, 900.0 + 200 * r_regionkey AS lo, 1150.0 + 200 * r_regionkey AS hi FROM region)
       ON p_retailprice >= lo AND p_retailprice < hi""",
)
def range_bands(t: Tables):
    bands = t.region.select(F.col("r_regionkey").alias("band"), (900.0 + 200 * F.col("r_regionkey")).alias("lo"), (1150.0 + 200 * F.col("r_regionkey")).alias("hi"))
    return R.range_join(t.part.select("p_partkey", "p_retailprice"), bands, "p_retailprice", "lo", "hi", 200.0).select("p_partkey", "band")


C.query("join_salted", "SELECT l_returnflag, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")(
    lambda t: R.salted_join(t.lineitem.select(F.col("l_orderkey").alias("k"), "l_returnflag"), t.orders.select(F.col("o_orderkey").alias("k"), "o_totalprice"), "k", 4)
    .groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 0).alias("total"))
)

C.sql(
    "lateral_explode",
    "SELECT w, count(*) AS n FROM {part} LATERAL VIEW explode(split(p_name, ' ')) x AS w GROUP BY w",
    "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY w",
)
C.sql(
    "lateral_explode_outer",
    "SELECT n_nationkey, w FROM {nation} LATERAL VIEW OUTER explode(CASE WHEN n_regionkey > 1 THEN split(n_name, 'A') END) x AS w",
    "SELECT n_nationkey, w FROM nation LEFT JOIN LATERAL (SELECT unnest(CASE WHEN n_regionkey > 1 THEN string_split(n_name, 'A') END) AS w) ON true",
)
C.sql(
    "lateral_posexplode",
    "SELECT p_partkey, pos, w FROM {part} LATERAL VIEW posexplode(split(p_name, ' ')) x AS pos, w",
    "SELECT p_partkey, CAST(unnest(range(len(w0))) AS INT) AS pos, unnest(w0) AS w FROM (SELECT p_partkey, string_split(p_name, ' ') AS w0 FROM part)",
)
C.sql(
    "lateral_stack",
    "SELECT o_orderkey, kind, v FROM {orders} LATERAL VIEW stack(2, 'status', o_orderstatus, 'priority', o_orderpriority) x AS kind, v",
    "SELECT o_orderkey, 'status' AS kind, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders",
)
C.sql("select_stack", "SELECT stack(3, 'a', 1, 'b', 2, 'c', 3) AS (k, v)", "SELECT * FROM (VALUES ('a', 1), ('b', 2), ('c', 3)) AS x(k, v)")
C.sql(
    "lateral_json_tuple",
    "SELECT event_id, k FROM {events} LATERAL VIEW json_tuple(props, 'k') x AS k",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)
C.sql(
    "lateral_inline",
    "SELECT n_nationkey, a, b FROM {nation} LATERAL VIEW inline(array(named_struct('a', n_name, 'b', n_regionkey))) x AS a, b",
    "SELECT n_nationkey, n_name AS a, n_regionkey AS b FROM nation",
)

_A, _B = "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 9000", "SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 5000"
for _name, _op in (("union_all", "UNION ALL"), ("union", "UNION"), ("intersect", "INTERSECT"), ("intersect_all", "INTERSECT ALL"), ("except", "EXCEPT"), ("except_all", "EXCEPT ALL")):
    C.sql(f"set_{_name}", f"{_A} {_op} {_B}")
C.sql("set_chain", f"(({_A} UNION {_B}) EXCEPT SELECT n_nationkey FROM {{nation}} WHERE n_regionkey = 1) INTERSECT SELECT n_nationkey FROM {{nation}} WHERE n_nationkey < 20 ORDER BY k LIMIT 10 OFFSET 1")

C.sql(
    "cte_shared",
    """WITH totals AS (SELECT o_custkey AS k, sum(o_totalprice) AS total, count(*) AS n FROM {orders} GROUP BY 1), big(k, total) AS (SELECT k, total FROM totals WHERE n > 12)
       SELECT t.k, round(t.total, 2) AS total, b.k IS NOT NULL AS is_big FROM totals t LEFT JOIN big b ON t.k = b.k""",
)
C.sql("cte_recursive", "WITH RECURSIVE f(n, v) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, v * (n + 1) FROM f WHERE n < 15) SELECT n, v FROM f")


@C.query(
    "cte_closure",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS src, (n_nationkey * 7 + 3) % 25 AS dst FROM nation UNION SELECT n_nationkey, n_regionkey FROM nation),
       c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src) SELECT src, dst FROM c""",
)
def cycle_closure(t: Tables):
    one = t.nation.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("dst"))
    return R.closure(one.union(t.nation.select("n_nationkey", "n_regionkey")))


@C.query("view_over_view", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 5000 GROUP BY 1")
def view_over_view(t: Tables):
    t.customer.where("c_acctbal > 5000").createOrReplaceTempView("tessera_rich")
    t.nation.createOrReplaceTempView("tessera_nation")
    t.spark.sql("CREATE OR REPLACE TEMP VIEW tessera_named AS SELECT n_name FROM tessera_rich JOIN tessera_nation ON c_nationkey = n_nationkey")
    return t.spark.sql("SELECT n_name, count(*) AS n FROM tessera_named GROUP BY n_name")


QUERIES, ORACLE = C.queries, C.oracle
