import pytest
from pyspark.sql import functions as F

from tessera.engine import Engine


@pytest.fixture
def engine(spark):
    own = Engine(spark, "engine_test")
    yield own
    for t in own.spark.catalog.listTables():
        own.drop_view(t.name) if t.tableType == "VIEW" else own.drop_table(t.name)
    own.use_database("default")


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def test_rows_in_and_out(engine):
    engine.store("people", [{"name": "ann", "age": 30}, {"name": "bob", "age": 40}])
    engine.store("people", [{"name": "cy", "age": 50, "city": "x"}])
    assert rows(engine.table("people"), "name", "age", "city") == [("ann", 30, None), ("bob", 40, None), ("cy", 50, "x")]
    ids = [r[0] for r in rows(engine.table("people"), "_id")]
    assert ids == [1, 2, 3] and rows(engine.retrieve("people", [3]), "name") == [("cy",)]
    engine.update("people", {"age": F.col("age") + 1}, F.col("name") == "ann")
    engine.delete("people", F.col("city") == "x")
    assert rows(engine.table("people"), "name", "age") == [("ann", 31), ("bob", 40)] and engine.count_rows("people") == 2
    engine.replace("people", engine.spark.createDataFrame([(2, "rob", 41), (9, "zoe", 1)], "_id long, name string, age long"))
    assert rows(engine.table("people"), "_id", "name", "age") == [(1, "ann", 31), (2, "rob", 41), (9, "zoe", 1)]
    assert rows(engine.execute("SELECT count(*) AS n FROM people WHERE age > 30"), "n") == [(2,)]


def test_tables_and_columns(engine):
    engine.create_table("t", "_id long, a int")
    with pytest.raises(ValueError):
        engine.create_table("t", "a int")
    engine.add_column("t", "b", "string")
    engine.rename_column("t", "a", "c")
    engine.drop_column("t", "b")
    assert engine.fields("t") == {"_id": "bigint", "c": "int"} and engine.list_tables() == ["t"]
    assert "engine_test" in engine.list_databases() and engine.truncate("t").count() == 0


def test_search(engine, tmp_path):
    engine.store("notes", [{"text": "Red house by the sea"}, {"text": "the house is red"}, {"text": "green hose"}])
    engine.build_index("notes", "text")
    assert len(rows(engine.search_text("notes", "text", "RED house"), "_id")) == 2
    assert rows(engine.search_text("notes", "text", '"red house"'), "text") == [("Red house by the sea",)]
    assert len(rows(engine.search_text("notes", "text", "hous", fuzzy=True), "_id")) >= 2
    engine.store("v", engine.spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, None), (4, [1.0])], "_id long, v array<float>"))
    assert [r._id for r in engine.top_k("v", "v", [1.0, 0.9], 5).collect()] == [2, 1]
    path = str(tmp_path / "out")
    engine.copy_to("notes", path, "json")
    assert engine.copy_from("back", path, "json").count() == 3
    engine.register_temp_table("file_view", path, kind="json")
    assert engine.execute("SELECT * FROM file_view").count() == 3
    engine.drop_temp_table("file_view")


def test_constraints_hold(engine):
    new = lambda *r: engine.spark.createDataFrame(list(r), "_id long, city string, age int")
    engine.store("cities", engine.spark.createDataFrame([(1, "x"), (2, "y")], "_id long, city string"))
    engine.store("people", new((1, "x", 3), (2, None, None)))
    engine.constrain("people", not_null=["_id"], unique=[["_id"]], check={"age": "age >= 0 AND city <> 'it''s'"}, references={"city": ("cities", "city")})
    for bad in ((1, "x", 3), (None, "x", 3), (5, "x", -1), (5, "z", 3), (5, "it's", 3)):
        with pytest.raises(ValueError):
            engine.store("people", new(bad))
    for bad in (lambda: engine.update("people", {"age": F.lit(-1)}), lambda: engine.replace("people", new((1, "z", 1))), lambda: engine.delete("cities", F.col("city") == "x")):
        with pytest.raises(ValueError):
            bad()
    engine.store("people", new((3, "y", None)))
    engine.delete("people", F.col("city") == "x")
    engine.delete("cities", F.col("city") == "x")
    assert rows(engine.table("people"), "_id") == [(2,), (3,)] and len(engine.constraints("people")) == 4
    assert {r.n for r in engine.integrity_check("people").collect()} == {0} and engine.integrity_check("cities").collect() == []
    with pytest.raises(ValueError):
        engine.constrain("people", not_null=["age"])


def test_append_keeps_the_files(engine):
    engine.store("t", [{"a": 1}])
    before = set(engine.table("t").inputFiles())
    engine.store("t", engine.table("t").select((F.col("a") + 1).alias("a")))
    assert before < set(engine.table("t").inputFiles()) and rows(engine.table("t"), "_id", "a") == [(1, 1), (2, 2)]
    engine.truncate("t")
    engine.store("t", [{"a": 7}])
    assert rows(engine.table("t"), "_id", "a") == [(1, 7)]


def test_index_follows_changes(engine):
    engine.store("notes", [{"text": "red house red"}, {"text": "red sea"}])
    engine.build_index("notes", "text")
    found = lambda q, **k: [r[0] for r in rows(engine.search_text("notes", "text", q, **k), "_id")]
    engine.store("notes", [{"text": "new house"}])
    assert found("house") == [1, 3] and engine.list_indexes("notes") == ["text"]
    engine.update("notes", {"text": F.lit("blue sky")}, F.col("_id") == 1)
    assert found("house") == [3] and found('"blue sky"') == [1] and found("hous", fuzzy=True) == [3]
    engine.delete_ids("notes", [3])
    assert found("house") == [] and engine.index_stats("notes", "text").first().docs == 2
    ranked = engine.search_ranked("notes", "text", "sky sea", 1).collect()
    assert len(ranked) == 1 and ranked[0].score > 0
    engine.drop_index("notes", "text")
    assert engine.list_indexes("notes") == [] and engine.list_tables() == ["notes"]


def test_scripts_variables_views(engine):
    import pandas as pd

    engine.from_pandas("t", pd.DataFrame({"a": [1, 2, 3]}))
    last = engine.execute_script("-- first; a comment\nCREATE OR REPLACE VIEW big AS SELECT * FROM t WHERE a > 1; /* ; */ SELECT ';' AS s, count(*) AS n FROM big;\n-- end\n")
    assert rows(last, "s", "n") == [(";", 2)] and engine.execute_script(" ; -- none") is None
    engine.set_variable("least", 3)
    assert rows(engine.execute("SELECT a FROM t WHERE a >= least"), "a") == [(3,)]
    engine.reset_variable("least")
    assert engine.create_view("small", "SELECT a FROM t WHERE a < 2").count() == 1
    engine.drop_view("small")
    assert "small" not in engine.list_tables()
    assert "seconds:" in engine.explain("SELECT count(*) FROM t", analyze=True) and engine.stats("t").count() == 2
    engine.delete_ids("t", engine.spark.createDataFrame([(1,), (2,)], "x long"))
    assert [len(r.collect()) for r in engine.execute_batch(["SELECT * FROM t", "SELECT * FROM big"])] == [1, 1]
