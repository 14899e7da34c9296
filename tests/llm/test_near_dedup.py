import pytest
from pyspark.sql import functions as F

from tessera.llm import near_dedup
from tests.compare import connect, same

SCHEMA = "doc_id long, text string"


def brute(rows):
    """(doc_id: (n_shingles, component)) by comparing all pairs of sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}


def test_against_all_pairs(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(i, base.replace(f"w{20 + i} ", f"x{i} ") if i % 3 else base) for i in range(1, 40)]
    chain = [f"c{i}" for i in range(80)]
    for k in range(25):  # each step is near the last, the ends are far apart
        chain = [*chain[3:], f"d{k}a", f"d{k}b", f"d{k}c"]
        rows.append((100 + k, " ".join(chain)))
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "one two"), (204, "ONE\ttwo "), (205, "one two three"), (206, "é É")]
    assert found(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_tables_of_the_small_scale(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs) == brute(rows)


def test_oracle(spark):
    sf = "/root/testdata/sf0.01"
    for name, sql in near_dedup.ORACLE.items():
        same(spark, connect(sf), sf, near_dedup.QUERIES[name], sql)


def test_small_tiles_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole = found(docs)
    monkeypatch.setattr(near_dedup, "TILE", 3)
    monkeypatch.setattr(near_dedup, "CHUNK", 2)
    assert found(docs) == whole


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(empty).collect() == []
    extra = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")], SCHEMA).withColumn("component", F.lit("x")).withColumn("token", F.lit(1))
    rows = sorted(map(tuple, near_dedup.near_duplicates(extra).collect()))
    assert rows == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_rows_without_an_id(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (7, "A b c d e f"), (None, "lone text of no id here"), (None, None), (3, "")], SCHEMA)
    rows = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(docs).collect()))
    assert rows == [(0, 0, 0, False), (0, 2, 0, False), (0, 2, 7, False), (3, 0, 3, True), (7, 2, 7, True)]


@pytest.mark.parametrize("text", ["word " * 50_000, "x" * 400_000])
def test_very_long(spark, text):
    got = found(spark.createDataFrame([(1, text), (2, text + " y")], SCHEMA))
    assert set(got) == {1, 2}
