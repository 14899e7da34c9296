"""Scalar function families."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import conditional, dates, maths, strings
from tessera.functions import json as J
from tessera.plans.declare import Catalogue, Tables

C = Catalogue()
c = F.col


@C.query(
    "strings_basic",
    """SELECT p_partkey, upper(p_name) AS up, lower(p_type) AS low, length(p_name) AS n, concat('x', p_brand, NULL) AS cat, concat_ws('-', p_brand, p_type) AS ws,
              substr(p_name, 2, 4) AS mid, left(p_name, 3) AS l3, right(p_name, 3) AS r3, replace(p_name, 'a', '_') AS rep, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp,
              reverse(p_name) AS rev, repeat(p_brand, 2) AS twice, ascii(p_name) AS code, chr(65 + CAST(p_size AS INT) % 26) AS letter, instr(p_name, 'e') AS at_e, md5(p_name) AS digest FROM part""",
)
def strings_basic(t: Tables):
    return t.part.select(
        "p_partkey", F.upper("p_name").alias("up"), F.lower("p_type").alias("low"), F.char_length("p_name").cast("long").alias("n"),
        strings.concat(F.lit("x"), c("p_brand"), F.lit(None)).alias("cat"), F.concat_ws("-", "p_brand", "p_type").alias("ws"),
        strings.substr(c("p_name"), 2, 4).alias("mid"), F.left("p_name", F.lit(3)).alias("l3"), F.right("p_name", F.lit(3)).alias("r3"),
        F.replace("p_name", F.lit("a"), F.lit("_")).alias("rep"), F.lpad("p_brand", 12, "*").alias("lp"), F.rpad("p_brand", 12, "*").alias("rp"),
        F.reverse("p_name").alias("rev"), F.repeat("p_brand", 2).alias("twice"), F.ascii("p_name").alias("code"),
        strings.char(65 + c("p_size") % 26).alias("letter"), F.instr("p_name", "e").cast("long").alias("at_e"), F.md5(c("p_name").cast("binary")).alias("digest"),
    )


@C.query(
    "strings_trim_case",
    """SELECT doc_id, regexp_replace(s, '^\\s+', '') AS l, regexp_replace(s, '\\s+$', '') AS r, trim(s, ' ' || chr(9) || chr(10)) AS b, n, locate FROM
       (SELECT doc_id, '  ' || substr(text, 1, 20) || chr(9) || ' ' AS s, length(substr(text, 1, 20)) AS n, strpos(substr(text, 3), 'e') + CASE WHEN strpos(substr(text, 3), 'e') > 0 THEN 2 ELSE 0 END AS locate FROM documents WHERE lang = 'en')""",
)
def strings_trim(t: Tables):
    s = F.concat(F.lit("  "), F.substring("text", 1, 20), F.lit("\t "))
    return t.documents.where("lang = 'en'").select(
        "doc_id", strings.ltrim(s).alias("l"), strings.rtrim(s).alias("r"), strings.trim(s).alias("b"),
        F.char_length(F.substring("text", 1, 20)).cast("long").alias("n"), F.locate("e", c("text"), 3).cast("long").alias("locate"),
    )


@C.query(
    "strings_trim_whole",
    """SELECT doc_id, regexp_replace(s, '^\\s+', '') AS l, regexp_replace(s, '\\s+$', '') AS r, trim(s, ' ' || chr(9) || chr(10)) AS b, length(text) AS n,
              strpos(substr(text, 3), 'e') + CASE WHEN strpos(substr(text, 3), 'e') > 0 THEN 2 ELSE 0 END AS locate
       FROM (SELECT doc_id, text, '  ' || text || chr(9) || ' ' AS s FROM documents)""",
)
def strings_trim_whole(t: Tables):
    s = F.concat(F.lit("  "), "text", F.lit("\t "))
    return t.documents.select(
        "doc_id", strings.ltrim(s).alias("l"), strings.rtrim(s).alias("r"), strings.trim(s).alias("b"),
        F.char_length("text").cast("long").alias("n"), F.locate("e", c("text"), 3).cast("long").alias("locate"),
    )


C.query("strings_initcap", "SELECT * FROM (VALUES ('Foo-Bar', 'foo-bar'), ('Ab 1c_De', 'aB 1C_dE'), ('', '')) x(title, s)")(
    lambda t: t.spark.createDataFrame([("foo-bar",), ("aB 1C_dE",), ("",)], "s string").select(strings.initcap(c("s")).alias("title"), "s")
)


@C.query(
    "strings_regex",
    """SELECT page_id, regexp_replace(url, '[0-9]+', '#', 'g') AS masked, CASE WHEN regexp_matches(url, '//([a-z.]+)/') THEN regexp_extract(url, '//([a-z.]+)/', 1) END AS host,
              regexp_matches(url, '#top$') AS is_top, string_split(url, '/')[4] AS part, len(string_split(url, '.')) AS dots FROM pages""",
)
def strings_regex(t: Tables):
    return t.pages.select(
        "page_id", F.regexp_replace("url", "[0-9]+", "#").alias("masked"), strings.regexp_extract(c("url"), "//([a-z.]+)/", 1).alias("host"), c("url").rlike("#top$").alias("is_top"),
        F.get(strings.split_literal(c("url"), "/"), F.lit(3)).alias("part"), F.size(strings.split_literal(c("url"), ".")).cast("long").alias("dots"),
    )


C.query("strings_glob", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, 'A.*EL')")(lambda t: t.part.where(strings.glob(c("p_type"), "A*EL")).select("p_partkey"))


@C.query(
    "maths_basic",
    """SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, floor(c_acctbal) AS f, ceil(c_acctbal) AS ce, sign(c_acctbal)::INT AS s, trunc(c_acctbal) AS t0,
              c_custkey % 7 AS m, CAST(NULL AS BIGINT) AS m0, greatest(c_acctbal, 100.0) AS g, least(c_acctbal, 100.0) AS l, round(pi(), 6) AS p, round(exp(1), 6) AS e FROM customer""",
)
def maths_basic(t: Tables):
    return t.customer.select(
        "c_custkey", F.abs("c_acctbal").alias("a"), F.round("c_acctbal", 1).alias("r"), maths.floor(c("c_acctbal")).alias("f"), maths.ceil(c("c_acctbal")).alias("ce"),
        maths.sign(c("c_acctbal")).alias("s"), maths.truncate(c("c_acctbal")).alias("t0"), maths.mod(c("c_custkey"), F.lit(7)).alias("m"), maths.mod(c("c_custkey"), F.lit(0)).alias("m0"),
        F.greatest("c_acctbal", F.lit(100.0)).alias("g"), F.least("c_acctbal", F.lit(100.0)).alias("l"), F.round(F.pi(), 6).alias("p"), F.round(F.e(), 6).alias("e"),
    )


@C.query(
    "maths_powers",
    """SELECT p_partkey, round(sqrt(p_retailprice), 6) AS r, round(pow(p_size, 2), 3) AS sq, round(exp(p_size / 50.0), 6) AS e, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS l10,
              round(log2(p_size), 6) AS l2, round(ln(p_size) / ln(3), 6) AS l3, round(sin(p_size), 6) AS s, round(cos(p_size), 6) AS c, round(tan(p_size), 4) AS t,
              round(asin(p_size / 60.0), 6) AS "as", round(acos(p_size / 60.0), 6) AS ac, round(atan(p_size), 6) AS at FROM part""",
)
def maths_powers(t: Tables):
    x = c("p_size")
    pairs = {
        "r": F.sqrt("p_retailprice"), "sq": F.pow(x, F.lit(2)), "e": F.exp(x / 50.0), "l": maths.log(x), "l10": maths.log(x, 10), "l2": maths.log(x, 2), "l3": maths.log(x, 3),
        "s": F.sin(x), "c": F.cos(x), "t": F.tan(x), "as": F.asin(x / 60.0), "ac": F.acos(x / 60.0), "at": F.atan(x),
    }
    digits = {"sq": 3, "t": 4}
    return t.part.select("p_partkey", *[F.round(v, digits.get(k, 6)).alias(k) for k, v in pairs.items()])


@C.query(
    "dates_parts",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INT) AS y, CAST(month(o_orderdate) AS INT) AS m, CAST(day(o_orderdate) AS INT) AS d, CAST(hour(o_orderdate) AS INT) AS h,
              CAST(minute(o_orderdate) AS INT) AS mi, CAST(second(o_orderdate) AS INT) AS s, strftime(o_orderdate, '%Y/%m on %d') AS f, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS u FROM orders""",
)
def dates_parts(t: Tables):
    d = c("o_orderdate").cast("timestamp")
    return t.orders.select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.day(d).alias("d"), F.hour(d).alias("h"), F.minute(d).alias("mi"), F.second(d).alias("s"),
        dates.date_format(d, "%Y/%m on %d").alias("f"), F.unix_timestamp(d).alias("u"),
    )


@C.query(
    "dates_arithmetic",
    """SELECT o_orderkey, CAST(d + 10 AS DATE) AS plus, CAST(d - 10 AS DATE) AS minus, CAST(d + INTERVAL 1 MONTH AS DATE) AS month_on, date_diff('day', DATE '1995-01-01', d) AS days,
              round((year(d) - 1995) * 12 + month(d) - 1 + (day(d) - 1) / 31.0, 6) AS months, d AS back FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""",
)
def dates_arithmetic(t: Tables):
    d, start = dates.to_date(c("o_orderdate")), F.lit("1995-01-01").cast("date")
    return t.orders.select(
        "o_orderkey", F.date_add(d, 10).alias("plus"), F.date_sub(d, 10).alias("minus"), F.add_months(d, 1).alias("month_on"), F.datediff(d, start).cast("long").alias("days"),
        F.round(dates.months_between(d, start), 6).alias("months"), F.from_unixtime(F.unix_timestamp(d.cast("timestamp")), "yyyy-MM-dd").cast("date").alias("back"),
    )


C.query("dates_bad", "SELECT * FROM (VALUES ('2024-02-29x', DATE '2024-02-29'), ('2023-02-30', NULL), ('no', NULL)) v(s, d)")(
    lambda t: t.spark.createDataFrame([("2024-02-29x",), ("2023-02-30",), ("no",)], "s string").select("s", dates.to_date(c("s")).alias("d"))
)


@C.query(
    "conditionals",
    """SELECT c_custkey, coalesce(k, -1) AS co, coalesce(k, 0) AS nv, nullif(c_nationkey, 4) AS nu, CASE WHEN k > 10 THEN 'a' ELSE 'b' END AS i, CASE WHEN k IS NOT NULL THEN 'set' ELSE 'unset' END AS n2,
              CASE c_nationkey WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE 'many' END AS de FROM (SELECT *, nullif(c_nationkey, 3) AS k FROM customer)""",
)
def conditionals(t: Tables):
    k = F.nullif("c_nationkey", F.lit(3))
    return t.customer.select(
        "c_custkey", F.coalesce(k, F.lit(-1)).alias("co"), F.nvl(k, F.lit(0)).alias("nv"), F.nullif("c_nationkey", F.lit(4)).alias("nu"), conditional.if_(k > 10, F.lit("a"), F.lit("b")).alias("i"),
        F.nvl2(k, F.lit("set"), F.lit("unset")).alias("n2"), conditional.decode(c("c_nationkey"), F.lit(1), F.lit("one"), F.lit(2), F.lit("two"), F.lit("many")).alias("de"),
    )


@C.query(
    "arrays_maps",
    """SELECT p_partkey, array_to_string(list_sort(w), ',') AS sorted_, array_to_string(w[2:3], ',') AS part_, len(w) AS n, w[1] AS head FROM (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)""",
)
def arrays_maps(t: Tables):
    w = F.split("p_name", " ")
    held = F.str_to_map(F.concat(F.lit("head:"), F.get(w, F.lit(0))), F.lit(","), F.lit(":"))
    return t.part.select("p_partkey", F.array_join(F.sort_array(w), ",").alias("sorted_"), F.array_join(F.slice(w, 2, 2), ",").alias("part_"), F.size(w).cast("long").alias("n"), held["head"].alias("head"))


@C.query(
    "json_read",
    """SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string('{"a":{"b":[1,2]}}', '$.a.b[1]') AS deep, 1 AS ok, 0 AS bad, 2 AS n, 0 AS none, 'OBJECT' AS kind FROM events""",
)
def json_read(t: Tables):
    fixed = F.lit('{"a":{"b":[1,2]}}')
    return t.events.select(
        "event_id", J.extract(c("props"), "$.k").alias("k"), J.extract(fixed, "$.a.b[1]").alias("deep"), J.valid(c("props")).alias("ok"), J.valid(F.lit("{x")).alias("bad"),
        J.array_length(F.lit("[1,2]")).alias("n"), J.array_length(F.lit("{}")).alias("none"), J.json_type(c("props")).alias("kind"),
    )


@C.query("json_build", """SELECT n_nationkey, '{"name":"' || n_name || '","none":null}' AS o, '["' || n_name || '","x"]' AS a FROM nation""")
def json_build(t: Tables):
    return t.nation.select("n_nationkey", J.object_(("name", c("n_name")), ("none", F.lit(None).cast("string"))).alias("o"), J.array(c("n_name"), F.lit("x")).alias("a"))


@C.query(
    "json_change",
    """SELECT event_id, '{"k":1}' AS s, '{"k":' || json_extract_string(props, '$.k') || ',"new":"v"}' AS i, '{"k":' || json_extract_string(props, '$.k') || '}' AS r, '{}' AS d FROM events""",
)
def json_change(t: Tables):
    p = c("props")
    return t.events.select("event_id", J.set_(p, "$.k", 1).alias("s"), J.insert(p, "$.new", "v").alias("i"), J.replace(p, "$.new", "v").alias("r"), J.remove(p, "$.k").alias("d"))


C.query("strings_space", "SELECT p_partkey, p_brand || repeat(' ', CAST(p_size AS INT) % 4) || '|' AS padded FROM part")(
    lambda t: t.part.select("p_partkey", F.concat("p_brand", strings.space(c("p_size") % 4), F.lit("|")).alias("padded"))
)
C.query("json_length_at_path", """SELECT o_orderkey, o_custkey % 3 AS n, 0 AS none FROM orders""")(
    lambda t: t.orders.withColumn("j", F.to_json(F.struct(F.struct(F.slice(F.array(c("o_orderkey"), c("o_custkey")), F.lit(1), (c("o_custkey") % 3).cast("int")).alias("b")).alias("a"))))
    .withColumn("j", F.when(c("o_custkey") % 3 < 2, c("j")).otherwise(F.lit('{"a":{"b":[1,[2,3]]}}')))
    .select("o_orderkey", J.array_length(c("j"), "$.a.b").cast("long").alias("n"), J.array_length(c("j"), "$.a").alias("none"))
)


@C.query("random_and_now", "SELECT count(*) AS n, 0 AS out_of_range, true AS spread, 1 AS times, true AS day FROM orders")
def random_and_now(t: Tables):
    """What holds of values that differ by run."""
    own = t.orders.select(maths.rand().alias("r"), dates.now().alias("at"), dates.current_date().alias("day"))
    return own.agg(
        F.count("*").alias("n"), F.count(F.when((c("r") < 0) | (c("r") >= 1), 1)).cast("int").alias("out_of_range"), (F.approx_count_distinct("r") > F.count("*") / 2).alias("spread"),
        F.count_distinct("at").cast("int").alias("times"), F.bool_and(F.to_date("at") == c("day")).alias("day"),
    )


C.sql("hashes", "SELECT doc_id, md5(text) AS m, sha2(text, 256) AS s FROM {documents}", "SELECT doc_id, md5(text) AS m, sha256(text) AS s FROM documents")

QUERIES, ORACLE = C.queries, C.oracle
