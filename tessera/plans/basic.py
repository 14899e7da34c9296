"""Scans, projections, predicates, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import relational as R
from tessera.plans.declare import Catalogue, Tables

C = Catalogue()


@C.query(
    "q_pricing_summary",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base,
              round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2 HAVING count(*) > 10 ORDER BY 1, 2""",
)
def pricing_summary(t: Tables):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"),
            F.round(F.sum(net), 2).alias("sum_net"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"),
        )
        .where("n > 10").orderBy("l_returnflag", "l_linestatus")
    )


C.sql("scan_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000")
C.sql("scan_without_from", "SELECT 1 AS one, 'a' AS a, CAST(NULL AS INT) AS nothing")
C.sql("scan_count", "SELECT count(*) AS n, count(1) AS ones FROM {lineitem}")
C.sql("scan_point", "SELECT * FROM {customer} WHERE c_custkey IN (1, 7, 42, 99999999)")

C.sql(
    "project_expressions",
    """SELECT o_orderkey AS k, o_totalprice * 2 + 1 AS twice, -o_totalprice AS neg, upper(o_orderpriority) AS p, o_orderkey % 7 AS rest,
              CAST(o_totalprice AS BIGINT) AS whole, CAST(o_orderkey AS STRING) AS text, 1.5D AS num, TRUE AS yes FROM {orders}""",
    """SELECT o_orderkey AS k, o_totalprice * 2 + 1 AS twice, -o_totalprice AS neg, upper(o_orderpriority) AS p, o_orderkey % 7 AS rest,
              CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS text, CAST(1.5 AS DOUBLE) AS num, TRUE AS yes FROM orders""",
)
C.sql(
    "project_case",
    """SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band,
              CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM {orders}""",
)
C.query("project_exclude", "SELECT * EXCLUDE (c_acctbal, c_name) FROM customer")(lambda t: R.exclude(t.customer, "c_acctbal", "c_name"))
C.query("project_replace", "SELECT * REPLACE (upper(n_name) AS n_name) FROM nation")(lambda t: R.replace(t.nation, n_name=F.upper("n_name")))
C.query("project_columns_regex", "SELECT COLUMNS('key|name') FROM nation")(lambda t: R.columns_like(t.nation, "key|name"))
C.query("project_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")(lambda t: t.lineitem.select("l_returnflag", "l_linestatus").distinct())
C.query(
    "project_distinct_on",
    "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
)(lambda t: R.distinct_on(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")))
C.sql("project_qualified_star", "SELECT n.*, r.r_name FROM {nation} n JOIN {region} r ON n.n_regionkey = r.r_regionkey")


@C.query("project_session_variable", "SELECT c_custkey, 5000.0::DOUBLE AS bound FROM customer WHERE c_acctbal > 5000.0")
def session_variable(t: Tables):
    """A variable is a literal of the plan: no plan text to rewrite."""
    bound = F.lit(5000.0)
    return t.customer.where(F.col("c_acctbal") > bound).select("c_custkey", bound.alias("bound"))


C.query("project_array_index", "SELECT p_partkey, string_split(p_name, ' ')[1] AS first_word, string_split(p_name, ' ')[100] AS none FROM part")(
    lambda t: t.part.select("p_partkey", F.get(F.split("p_name", " "), F.lit(0)).alias("first_word"), F.get(F.split("p_name", " "), F.lit(99)).alias("none"))
)

C.sql("where_comparisons", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity >= 10 AND l_quantity <= 40 AND l_discount <> 0.05 AND NOT (l_tax > 0.06) AND l_returnflag != 'R' AND l_linenumber < 5")
C.sql(
    "where_three_valued",
    """SELECT c_custkey, b IS NULL AS unknown, (b AND c_custkey > 10) AS both_, (b OR c_custkey > 10) AS either, NOT b AS opposite
       FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal > 5000 END AS b FROM {customer})""",
)
C.sql("where_between_in", "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 50000 AND 90000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('5-LOW') AND o_custkey NOT BETWEEN 10 AND 20")
C.sql("where_null_in", "SELECT c_custkey FROM {customer} WHERE nullif(c_mktsegment, 'BUILDING') NOT IN ('MACHINERY', 'FURNITURE')")
C.sql("where_is_null", "SELECT c_custkey FROM {customer} WHERE nullif(c_nationkey, 3) IS NULL OR nullif(c_nationkey, 4) IS NOT NULL AND c_acctbal < 0")
C.sql("where_like", "SELECT p_partkey, p_name FROM {part} WHERE p_name LIKE '%a%' AND p_type NOT LIKE '%BRASS' AND p_brand LIKE 'Brand#_2'")
C.sql("where_regexp", "SELECT page_id FROM {pages} WHERE url RLIKE 'https?://[a-z.]+/en/[0-9]*5' AND NOT url RLIKE 'top$'", "SELECT page_id FROM pages WHERE regexp_matches(url, 'https?://[a-z.]+/en/[0-9]*5') AND NOT regexp_matches(url, 'top$')")
C.sql("where_in_subquery", "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 8000)")
C.sql("where_not_in_null", "SELECT count(*) AS n FROM {orders} WHERE o_custkey NOT IN (SELECT nullif(c_custkey, 5) FROM {customer})")
C.sql("where_not_in", "SELECT o_orderkey FROM {orders} WHERE o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_acctbal > 0 AND c_custkey IS NOT NULL)")
C.sql("where_exists", "SELECT c_custkey FROM {customer} c WHERE EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 250000)")
C.sql("where_not_exists", "SELECT c_custkey FROM {customer} c WHERE NOT EXISTS (SELECT 1 FROM {orders} o WHERE o.o_custkey = c.c_custkey)")
C.sql("scalar_subquery", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > (SELECT 1.8 * avg(o_totalprice) FROM {orders})")
C.sql("scalar_subquery_correlated", "SELECT c_custkey, (SELECT max(o_totalprice) FROM {orders} o WHERE o.o_custkey = c.c_custkey) AS most FROM {customer} c")
C.sql("scalar_subquery_empty", "SELECT r_name, (SELECT n_name FROM {nation} WHERE n_nationkey = -1) AS none FROM {region}")
C.sql(
    "arithmetic",
    "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS frac, l_linenumber DIV 2 AS whole, l_orderkey % 3 AS rest, -l_linenumber AS neg, l_quantity - l_tax * 2 AS mix, try_divide(l_linenumber, 0) AS none FROM {lineitem}",
    "SELECT l_orderkey, l_linenumber, l_linenumber / 2 AS frac, CAST(l_linenumber // 2 AS BIGINT) AS whole, l_orderkey % 3 AS rest, -l_linenumber AS neg, l_quantity - l_tax * 2 AS mix, CAST(NULL AS DOUBLE) AS none FROM lineitem",
)

C.query("order_by_nulls", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS FIRST, c_acctbal NULLS LAST, c_custkey LIMIT 200")(
    lambda t: t.customer.withColumn("k", F.nullif("c_nationkey", F.lit(3))).orderBy(F.col("k").desc_nulls_first(), F.col("c_acctbal").asc_nulls_last(), "c_custkey").limit(200).select("c_custkey", "k")
)
C.query("order_by_nulls_whole", "SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer ORDER BY k DESC NULLS FIRST, c_acctbal NULLS LAST, c_custkey")(
    lambda t: t.customer.withColumn("k", F.nullif("c_nationkey", F.lit(3))).orderBy(F.col("k").desc_nulls_first(), F.col("c_acctbal").asc_nulls_last(), "c_custkey").select("c_custkey", "k")
)
C.sql("order_by_expression_whole", "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice % 100 DESC, p_partkey")
C.sql("order_limit_offset", "SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 30")
C.sql("order_by_expression", "SELECT p_partkey, p_retailprice FROM {part} ORDER BY p_retailprice % 100 DESC, p_partkey LIMIT 50")
C.query("top_k", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)
)
C.query("sort_within", "SELECT s_suppkey, s_nationkey FROM supplier")(lambda t: t.supplier.select("s_suppkey", "s_nationkey").repartition("s_nationkey").sortWithinPartitions("s_suppkey"))

QUERIES, ORACLE = C.queries, C.oracle
