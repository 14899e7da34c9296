import hashlib

import corpus_pipeline as cp
from tests.llm.test_near_dedup import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        docs = cp.write_shared(out, name)
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after) and set(after) <= set(before)
        if name == "language_id":
            assert len(after) > 0.97 * len(before)
        elif name == "near_dedup":
            groups = brute([(i, r.text) for i, r in before.items()])
            assert set(after) == {i for i, (_, c) in groups.items() if i == c}
        elif name == "secrets":
            assert set(after) == set(before)
            assert all(len(r.text) == r.n_chars for r in after.values() if "[SECRET]" in r.text)
        if name != "secrets":
            assert all(after[i] == before[i] for i in after)
        before = after
    last = cp.STAGES[-1][1](spark, docs, SF).collect()
    assert {r.doc_id for r in last} == set(before)
    assert all(r.decoded_sha256 == hashlib.sha256(before[r.doc_id].text.encode()).hexdigest() for r in last)


def test_run(spark):
    rows = cp.run(spark, SF).collect()
    assert rows and all(r.n_tokens == r.ids.count(",") + 1 for r in rows)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    docs = spark.createDataFrame([(1, None, None, None, None, None), (2, "the house is here", "en", "a", 17, "x"), (2, "the house is here", "en", "a", 17, "x"), (3, "password = hunter2hunter2", "en", None, None, None)], schema)
    for rows, want in ((docs, {2, 3}), (docs.limit(0), set())):
        for name, stage in cp.STAGES[:-1]:
            rows = cp.write_shared(stage(spark, rows, SF), name)
        found = rows.collect()
        assert {r.doc_id for r in found} == want and len(found) == len(want)
        assert all(r.text == "[SECRET]" and r.n_chars == 8 for r in found if r.doc_id == 3)
