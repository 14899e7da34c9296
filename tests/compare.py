"""Compare queries with their DuckDB oracle: rows, columns, values."""

import sys
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and v == 0:
        return 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, con, sf, query, sql):
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    found = con.sql(sql)
    columns, want = list(found.columns), found.fetchall()
    assert sorted(df.columns) == sorted(columns), (df.columns, columns)
    want = rows_of(columns, want)
    assert len(got) == len(want), (len(got), len(want))
    for g, w in zip(got, want):
        assert repr(g) == repr(w), (sorted(columns), g, w)


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    from tessera import plans

    sf = sys.argv[1]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, bad = connect(sf), 0
    queries, oracle = plans.queries(), plans.oracle_sql()
    for name in sys.argv[2:] or queries:
        try:
            if name in oracle:
                same(spark, con, sf, queries[name], oracle[name])
            else:
                queries[name](spark, sf).collect()
        except Exception as e:
            bad += 1
            print("BAD", name, type(e).__name__, str(e)[:400].replace("\n", " "))
    print(len(queries), "queries,", bad, "bad")
