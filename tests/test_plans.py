"""Every query of the catalogue against its oracle SQL."""

import pytest

from tessera import plans
from tests.compare import connect, same

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = plans.queries(), plans.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    if name in ORACLE:
        same(spark, con, SF, QUERIES[name], ORACLE[name])
    else:
        assert QUERIES[name](spark, SF).collect()


@pytest.mark.parametrize("name", ["order_by_nulls_whole", "order_by_expression_whole"])
def test_order_of_all_rows(spark, con, name):
    assert [tuple(r) for r in QUERIES[name](spark, SF).collect()] == con.sql(ORACLE[name]).fetchall()


def test_byte_ranges_of_characters(spark, con, tmp_path):
    texts = ["Èéé repaeau le éreea", "plain words of ASCII", "abcdé", "日本語 text 👨 and more", "", None]
    own = spark.createDataFrame([(i, s, "en") for i, s in enumerate(texts)], "doc_id long, text string, lang string")
    own.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.part, r.size) for r in QUERIES["blob_range"](spark, str(tmp_path)).collect()}
    found = con.sql(ORACLE["blob_range"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    assert got == {i: (part, size) for i, part, size in found.fetchall()} and len(got) == 6
