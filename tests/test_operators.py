"""Edge cases of operators and functions: NULLs, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from tessera import sources
from tessera.functions import conditional, dates, maths, strings
from tessera.functions import json as J
from tessera.operators import dml, fts, relational, vector


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'long'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_functions(spark):
    c = F.col("s")
    assert one(spark, strings.trim(c), s="　 a b\t ") == "a b"
    assert one(spark, strings.initcap(c), s="o'neil FOO-bar") == "O'Neil Foo-Bar"
    assert one(spark, strings.concat(c, F.lit(None), F.lit(1)), s="a") == "a1"
    assert one(spark, strings.substr(c, -3, 2), s="abc") == "ab"
    assert one(spark, strings.split_literal(c, "."), s="a.b") == ["a", "b"] and one(spark, strings.split_literal(c, "."), s="") == []
    assert one(spark, strings.regexp_extract(c, "x"), s="abc") is None
    assert one(spark, strings.char(F.lit(0x1F600))) == "\U0001f600"
    assert one(spark, maths.truncate(F.lit(-1.29), 1)) == -1.2 and one(spark, maths.mod(F.lit(5), F.lit(0))) is None
    assert one(spark, F.isnan(maths.log(F.lit(-1.0)))) is True and one(spark, maths.log(F.lit(None).cast("double"))) is None
    assert one(spark, dates.to_date(c), s="2024-13-01") is None
    assert one(spark, dates.months_between(F.lit("2024-03-31").cast("date"), F.lit("2024-02-29").cast("date"))) == pytest.approx(1 + 2 / 31)
    assert one(spark, conditional.decode(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit("same"), F.lit("else"))) == "else"


def test_json_changes(spark):
    c = F.col("s")
    text = '{"a":[1,{"b":2}],"c":null}'
    assert one(spark, J.set_(c, "$.a[1].b", "x"), s=text) == '{"a":[1,{"b":"x"}],"c":null}'
    assert one(spark, J.insert(c, "$.c", 5), s=text) == text and one(spark, J.replace(c, "$.c", 5), s=text) == '{"a":[1,{"b":2}],"c":5}'
    assert one(spark, J.remove(c, "$.a[0]"), s=text) == '{"a":[{"b":2}],"c":null}'
    assert one(spark, J.set_(c, "$.x.y", 1), s=text) == text and one(spark, J.set_(c, "$.x", 1), s="no json") is None
    assert [one(spark, J.json_type(c), s=s) for s in ("[1]", "1.5", "2", "true", '"x"', "null", None)] == ["ARRAY", "REAL", "INTEGER", "BOOLEAN", "STRING", "NULL", "NULL"]


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.99, 1.0])
def test_exact_percentile(spark, p):
    import random

    rnd = random.Random(1)
    data = [(k, float(rnd.choice([rnd.randint(0, 5), rnd.random() * 100]))) for k in ("a", None, "b") for _ in range(rnd.randint(1, 500))] + [("n", None)]
    got = {r.k: r.percentile for r in relational.exact_percentile(spark.createDataFrame(data, "k string, v double"), ["k"], "v", p).collect()}
    for k in ("a", None, "b"):
        own = sorted(v for kk, v in data if kk == k)
        assert got[k] == own[int((len(own) - 1) * p + 0.5)]
    assert "n" not in got


def test_range_join_against_loops(spark):
    points = [(float(x),) for x in (-3, 0, 0.5, 1, 2.5, 9.99, 10)] + [(None,)]
    ranges = [(-5.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.5, 10.0), (10.0, 11.0)]
    want = sorted((p, a, b) for p, in points for a, b in ranges if p is not None and a <= p < b)
    for width in (0.3, 2.0, 100.0):
        got = relational.range_join(spark.createDataFrame(points, "p double"), spark.createDataFrame(ranges, "a double, b double"), "p", "a", "b", width)
        assert sorted(map(tuple, got.select("p", "a", "b").collect())) == want


def test_relational_edges(spark):
    df = spark.createDataFrame([(1, "x", 2.0), (1, "y", 2.0), (2, None, None)], "k int, s string, v double")
    assert relational.replace(df, s=F.upper("s")).columns == ["k", "s", "v"]
    for bad in (lambda: relational.exclude(df, "zz"), lambda: relational.replace(df, zz=F.lit(1)), lambda: relational.salted_join(df, df, "k", 2, "full")):
        with pytest.raises(ValueError):
            bad()
    assert len(relational.distinct_on(df, ["k"], F.desc("v"), F.asc("s")).collect()) == 2
    assert relational.closure(spark.createDataFrame([], "src int, dst int")).collect() == []
    assert sorted(map(tuple, relational.closure(spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src int, dst int")).collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    left = spark.createDataFrame([(1,), (1,), (3,)], "k int")
    assert sorted(map(tuple, relational.salted_join(left, df.select("k", "s"), "k", 3, "left").collect()), key=repr) == sorted([(1, "x"), (1, "y")] * 2 + [(3, None)], key=repr)


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert one(spark, vector.norm(a)) == 5 and one(spark, vector.cosine_distance(a, z)) == 1 and one(spark, vector.l2(a, z)) == 5
    assert one(spark, vector.linf(a, z)) == 4 and one(spark, vector.l1(a, z)) == 7 and one(spark, vector.l2(a, F.array(F.lit(1.0)))) is None
    assert one(spark, vector.to_text(F.array(F.lit(1.5), F.lit(2.0)))) == "[1.5, 2.0]"


def test_batch_top_k_in_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(40)], "id long, v array<float>")
    queries = df.where("id < 5").selectExpr("id AS query_id", "v AS query")
    whole = sorted(map(tuple, vector.batch_top_k(df, "v", "id", queries, 3).collect()))
    monkeypatch.setattr(vector, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, vector.batch_top_k(df, "v", "id", queries, 3).collect())) == whole and len(whole) == 15
    assert vector.batch_top_k(df, "v", "id", queries.limit(0), 3).collect() == []


@pytest.mark.parametrize("metric", ["l2", "l2_squared", "l1", "linf", "cosine", "dot"])
def test_batch_top_k_against_all_pairs(spark, monkeypatch, metric):
    import random

    rnd = random.Random(5)
    own = [[rnd.uniform(-1, 1) * scale for _ in range(6)] for scale in (1, 1, 1e-9, 1e6) for _ in range(30)]
    own += [own[3]] * 40 + [[float(i == j) for i in range(6)] for j in range(6)] * 3 + [[0.0] * 6] * 2
    own += [None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [3.0, 4.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(own)], "id long, v array<float>")
    queries = df.where("id % 3 = 0 OR id > 175").selectExpr("id AS query_id", "v AS query")
    dist = vector.METRICS[metric](F.col("v"), F.col("query"))
    pairs = df.crossJoin(queries).select("query_id", "id", dist.alias("dist")).where("dist IS NOT NULL")
    want = {}
    for q, i, d in sorted(map(tuple, pairs.collect()), key=lambda r: (r[0], r[2] != r[2], r[2], r[1])):
        if len(want.setdefault(q, [])) < 4:
            want[q].append((q, i, repr(d + 0.0)))
    for size in (16384, 7):
        monkeypatch.setattr(vector, "ROW_PART", size)
        got = vector.batch_top_k(df, "v", "id", queries, 4, metric)
        assert sorted((q, i, repr(d + 0.0)) for q, i, d in map(tuple, got.collect())) == sorted(r for rows in want.values() for r in rows)


def test_batch_top_k_compares_in_groups(spark):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(20)], "id long, v array<float>")
    text = vector.batch_top_k(df, "v", "id", df.selectExpr("id AS query_id", "v AS query"), 2)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroup" in text and "BroadcastNestedLoopJoin" not in text and "SortMergeJoin" not in text


def test_text_search(spark):
    docs = spark.createDataFrame([(1, "New York is new"), (2, "york new"), (3, None), (4, "日本語 text")], "id long, t string")
    index = fts.postings(docs, "id", "t")
    found = lambda df: sorted(r.doc for r in df.collect())
    assert found(fts.match(index, "new york")) == [1, 2] and found(fts.match(index, '"new york"')) == [1]
    assert found(fts.match(index, "日本")) == [4] and found(fts.match(index, "absent")) == []
    assert found(fts.fuzzy_match(index, "yorc")) == [1, 2] and found(fts.fuzzy_match(index, "new yorc")) == [1, 2]
    assert found(fts.fuzzy_match(index, "york new")) == [1, 2] and found(fts.fuzzy_match(index, "")) == []
    for empty in ("", '""', '"x"', '"'):
        assert found(fts.match(index, empty)) == []
    own = fts.postings(spark.createDataFrame([(1, "日本語文章 end"), (2, "日本 語文")], "id long, t string"), "id", "t")
    assert [found(fts.match(own, q)) for q in ("日", "日本", "日本語", "日本語文", "本語文章 end", "文章日")] == [[1, 2], [1, 2], [1], [1], [1], []]
    assert found(fts.bm25(index, fts.lengths(docs, "id", "t"), "")) == [] and found(fts.match(index, '"is new"')) == [1]


def test_postings_are_cut_without_a_shuffle(spark):
    docs = spark.createDataFrame([(1, "of the of"), (1, "of a the"), (2, "the of"), (3, "")], "id long, t string")
    index = fts.postings(docs, "id", "t")
    assert "Exchange" not in index._jdf.queryExecution().executedPlan().toString()
    found = lambda q: sorted(r.doc for r in fts.match(index, q).collect())
    # A document on two rows holds the terms of both, and no phrase twice begun.
    assert found("of the") == [1, 2] and found('"of the"') == [1] and found('"of the of"') == [1] and found('"of of"') == []
    assert tuple(fts.stats(index).first()) == (2, 2, 7)
    assert tuple(fts.stats(index.limit(0)).first()) == (0, 0, 0)


def test_phrase_places_are_shuffled_once(spark):
    docs = spark.createDataFrame([(1, "a1 b1 a1 b1"), (2, "b1 a1"), (3, "a1 a1 b1 日本"), (4, "a1 日本 b1")], "id long, t string")
    index = fts.postings(docs, "id", "t")
    found = lambda q: sorted(r.doc for r in fts.match(index, q).collect())
    assert found('"a1 b1"') == [1, 3, 4] and found('"a1 a1"') == [3] and found('"a1 b1 日本"') == [3, 4] and found('"b1 a1 b1"') == [1]
    text = fts.match(index, '"a1 b1"')._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1, text


def test_lengths_are_read_from_the_index(spark):
    from tessera import plans

    docs = spark.createDataFrame([(1, "New York is new"), (1, "york"), (2, ""), (3, None), (4, "日本語 text")], "id long, t string")
    index = fts.postings(docs, "id", "t")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(fts.held_lengths(index)) == rows(fts.lengths(docs, "id", "t")) == [(1, 1), (1, 4), (2, 0), (3, 0), (4, 1)]
    assert rows(fts.bm25(index, fts.held_lengths(index), "york 日本")) == rows(fts.bm25(index, fts.lengths(docs, "id", "t"), "york 日本"))
    text = plans.queries()["fts_bm25"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "text#" not in text  # no text is cut again


def test_only_near_terms_are_told_apart(spark):
    docs = spark.createDataFrame([(1, "thin thinner tinn"), (2, "thing then"), (3, "日本語 thinn")], "id long, t string")
    near = fts.fuzzy_terms(fts.postings(docs, "id", "t"), ["thinn", "thank"])
    text = near._jdf.queryExecution().optimizedPlan().toString()
    # The plan is read from its end: the distances come before (below) the distinct terms.
    assert text.rindex("levenshtein") > text.rindex("Aggregate [term")
    assert sorted(map(tuple, near.collect())) == [(0, "thin"), (0, "thing"), (0, "thinn"), (0, "thinner"), (0, "tinn")]


def test_changes(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (None, "n"), (3, "a"), (3, "c")], "k int, s string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(dml.upsert(t, new, ["k"])) == sorted([(1, "a"), (2, None), (3, "c"), (None, "n")], key=repr)
    assert rows(dml.upsert(t, new, ["k"], {"s": "s"})) == sorted([(1, "a"), (2, "b"), (3, "c"), (None, "n")], key=repr)
    assert rows(dml.delete(t, F.col("s") == "a")) == [(2, None)]
    assert rows(dml.update(t, {"s": F.lit("z")}, F.col("s") == "a")) == [(1, "z"), (2, None)]
    assert dml.with_ids(t.limit(0), "k").collect() == []


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, 'quo"te, x'), (2, None), (3, "é")], "k int, s string")
    for kind in ("csv", "tsv", "json", "parquet"):
        path = str(tmp_path / f"f.{kind}")
        sources.write(df, path, kind)
        assert sorted(map(tuple, sources.read(spark, path).select("k", "s").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        sources.read(spark, str(tmp_path / "f.xyz"))


def test_json_layouts(spark, tmp_path):
    import json

    from tessera.sources import json_layouts

    want = [(1, "a"), (2, None)]
    texts = {
        "split": {"columns": ["s", "k"], "index": [0, 1], "data": [["a", 1], [None, 2]]},
        "columns": {"k": {"0": 1, "1": 2}, "s": {"0": "a"}},
        "index": {"0": {"k": 1, "s": "a"}, "1": {"k": 2, "s": None}},
    }
    for layout, text in texts.items():
        (tmp_path / layout).write_text(json.dumps(text))
        assert sorted(map(tuple, json_layouts.read(spark, str(tmp_path / layout), layout, "k int, s string").collect())) == want
    with pytest.raises(ValueError):
        json_layouts.read(spark, str(tmp_path / "split"), "other", "k int")
