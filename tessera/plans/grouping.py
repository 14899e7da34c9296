"""Aggregations and windows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.declare import Catalogue, Tables

C = Catalogue()

C.sql("agg_global", "SELECT count(*) AS n, round(sum(l_quantity), 2) AS s, round(avg(l_tax), 8) AS a, min(l_shipdate) AS lo, max(l_returnflag) AS hi FROM {lineitem}")
C.sql("agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS s, avg(l_tax) AS a, min(l_returnflag) AS lo FROM {lineitem} WHERE l_quantity < 0")
C.sql("agg_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT CASE WHEN l_quantity > 40 THEN l_partkey END) AS parts, count(nullif(l_linestatus, 'F')) AS open_ FROM {lineitem} GROUP BY 1")
C.sql("agg_expressions", "SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END), 2) AS done, max(o_totalprice - o_custkey) AS most, min(length(o_orderpriority)) AS len FROM {orders} GROUP BY 1")
C.sql("group_null_key", "SELECT nullif(c_nationkey, 3) AS k, count(*) AS n FROM {customer} GROUP BY nullif(c_nationkey, 3)")
C.sql("group_expression", "SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM {orders} GROUP BY year(o_orderdate), month(o_orderdate)", "SELECT CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, count(*) AS n FROM {orders} GROUP BY 1, 2")
C.sql("group_alias", "SELECT substr(c_mktsegment, 1, 1) AS letter, count(*) AS n FROM {customer} GROUP BY letter")
C.sql("having_hidden", "SELECT l_suppkey FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 20 AND avg(l_quantity) > 25")
C.sql("group_without_aggregate", "SELECT c_mktsegment FROM {customer} GROUP BY c_mktsegment")
C.sql("grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())", "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping(l_returnflag) AS TINYINT) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linestatus), ())")
C.query("cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")(lambda t: t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")))
C.query("rollup", "SELECT c_nationkey, c_mktsegment, round(avg(c_acctbal), 4) AS a FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")(lambda t: t.customer.rollup("c_nationkey", "c_mktsegment").agg(F.round(F.avg("c_acctbal"), 4).alias("a")))
C.query("pivot", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O FROM orders GROUP BY 1")(
    lambda t: t.orders.groupBy("o_orderpriority").agg(*[F.count(F.when(F.col("o_orderstatus") == s, 1)).alias(s) for s in ("F", "O")])
)
C.query(
    "percentile_exact",
    """SELECT l_returnflag, list_sort(list(l_extendedprice))[CAST(floor((count(*) - 1) * 0.9 + 0.5) AS BIGINT) + 1] AS percentile FROM lineitem GROUP BY 1""",
)(lambda t: R.exact_percentile(t.lineitem, ["l_returnflag"], "l_extendedprice", 0.9))
C.query("percentile_exact_global", "SELECT list_sort(list(o_totalprice))[CAST(floor((count(*) - 1) * 0.5 + 0.5) AS BIGINT) + 1] AS percentile FROM orders")(lambda t: R.exact_percentile(t.orders, [], "o_totalprice", 0.5))
C.query("percentile_approx")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_quantity", 0.5, 10_000).alias("p50")))
C.query("collect_sorted", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), ',') AS names, array_to_string(list_sort(list_distinct(list(substr(n_name, 1, 1)))), ',') AS letters FROM nation GROUP BY 1")(
    lambda t: t.nation.groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list("n_name")), ",").alias("names"), F.array_join(F.sort_array(F.collect_set(F.substring("n_name", 1, 1))), ",").alias("letters"))
)
C.sql("listagg", "SELECT n_regionkey, listagg(n_name, ';') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY 1", "SELECT n_regionkey, string_agg(n_name, ';' ORDER BY n_name) AS names FROM nation GROUP BY 1")

_K = "o_custkey, o_orderkey"
C.sql("window_ranks", f"SELECT {_K}, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr FROM {{orders}} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
C.sql("window_ntile", f"SELECT {_K}, ntile(4) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS bucket FROM {{orders}}")
C.sql("window_shares", f"SELECT {_K}, percent_rank() OVER w AS pr, cume_dist() OVER w AS cd FROM {{orders}} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderstatus)")
C.sql("window_lag_lead", f"SELECT {_K}, lag(o_totalprice) OVER w AS before, lead(o_orderstatus, 2, 'none') OVER w AS later FROM {{orders}} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
_FULL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"
C.sql("window_values", f"SELECT {_K}, first_value(o_totalprice) OVER w AS first_, last_value(o_totalprice) OVER w AS last_, nth_value(o_totalprice, 2) OVER w AS second_ FROM {{orders}} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey {_FULL})")
C.sql("window_running", f"SELECT {_K}, round(sum(o_totalprice) OVER w, 2) AS running, count(*) OVER w AS n FROM {{orders}} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)")
C.sql("window_range_peers", f"SELECT {_K}, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peers FROM {{orders}}")
C.sql("window_whole", f"SELECT {_K}, round(avg(o_totalprice) OVER w, 1) AS a, min(o_totalprice) OVER w AS lo, max(o_orderstatus) OVER w AS hi, count(nullif(o_orderstatus, 'F')) OVER w AS n FROM {{orders}} WINDOW w AS (PARTITION BY o_custkey)")
C.sql("window_moving", f"SELECT {_K}, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS a FROM {{orders}}")
C.sql("window_over_aggregate", "SELECT c_nationkey, c_mktsegment, count(*) AS n, rank() OVER (PARTITION BY c_nationkey ORDER BY count(*) DESC) AS rk FROM {customer} GROUP BY 1, 2")


@C.query("window_top_per_group", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def top_per_group(t: Tables):
    return R.top_per_group(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], 3, F.desc("o_totalprice"), F.asc("o_orderkey"))


@C.query("window_sessions", "SELECT user_id, session, count(*) AS n FROM (SELECT user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2")
def sessions(t: Tables):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.lag(F.unix_micros(F.col("ts").cast("timestamp"))).over(w)
    new = F.when(gap <= 3_600_000_000, 0).otherwise(1)
    return t.events.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("user_id", "session").agg(F.count("*").alias("n"))


QUERIES, ORACLE = C.queries, C.oracle
