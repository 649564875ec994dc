"""Tables with row changes, definitions, marks, orders and settings."""

from __future__ import annotations

import json
import re

import pytest
from pyspark.sql import functions as F

from helioframe.operators import relational as R
from helioframe.operators import timeseries as T
from helioframe.operators.engine import Engine
from helioframe.plans.text import bind_marks, column_spec, ordering, pretty_size, split_list
from helioframe.sources import config


@pytest.fixture
def engine(spark):
    with Engine(spark, database="lab") as e:
        e.create_schema("research")
        yield e
        for t in e.list_tables("research", names_only=True):
            e.drop_table(t, "research")


EVENTS = {
    "id": "SERIAL PRIMARY KEY", "event_type": "VARCHAR(50) NOT NULL", "start_time": "TIMESTAMP NOT NULL", "end_time": "TIMESTAMP",
    "intensity": "FLOAT", "description": "TEXT", "created_at": "TIMESTAMP DEFAULT NOW()",
}
ROWS = [
    {"event_type": "solar_flare", "start_time": "2025-01-15 10:30:00", "intensity": 8.5},
    {"event_type": "CME", "start_time": "2025-01-16 14:20:00", "intensity": 7.2},
    {"event_type": "solar_wind", "start_time": "2025-01-17 08:15:00", "intensity": 5.8},
]


def test_demo_flow(engine):
    engine.create_table("solar_events", EVENTS, schema="research")
    engine.create_table("solar_events", {"other": "TEXT"}, schema="research")  # exists: nothing happens
    assert engine.insert("solar_events", ROWS[0], schema="research", return_id=True) == 1
    engine.insert("solar_events", ROWS[1:], schema="research")
    assert engine.count("solar_events", schema="research") == 3
    assert engine.count("solar_events", {"event_type": "solar_flare"}, "research") == 1
    assert engine.update("solar_events", {"intensity": 9.0}, {"event_type": "solar_flare"}, "research") == 1
    assert engine.select("solar_events", ["intensity"], {"event_type": "solar_flare"}, "research").first()[0] == 9.0
    assert engine.delete("solar_events", {"event_type": "solar_wind"}, "research") == 1
    assert engine.count("solar_events", schema="research") == 2
    rows = engine.execute("SELECT event_type, avg(intensity) AS m FROM lab__research.solar_events WHERE intensity > %s GROUP BY event_type ORDER BY m DESC", (1,), fetch=True)
    assert [r["event_type"] for r in rows] == ["solar_flare", "CME"]
    found = engine.select("solar_events", schema="research").collect()
    assert sorted(r["id"] for r in found) == [1, 2] and all(r["created_at"] for r in found)
    engine.vacuum("solar_events", full=True, schema="research")
    assert engine.count("solar_events", schema="research") == 2
    engine.truncate("solar_events", "research")
    assert engine.count("solar_events", schema="research") == 0


def test_listings(engine):
    engine.create_table("t", {"id": "SERIAL PRIMARY KEY", "name": "VARCHAR(10) UNIQUE", "n": "INTEGER DEFAULT 7", "doc": "JSONB"}, "research")
    d = {c["column_name"]: c for c in engine.describe_table("t", "research")}
    assert d["name"]["max_length"] == 10 and d["id"]["is_nullable"] == "NO" and d["n"]["default_value"] == "7"
    assert engine.describe_table("nothing", "research") == [] and not engine.table_exists("nothing")
    engine.insert("t", {"name": "a", "doc": {"k": 1}}, "research")
    assert engine.select("t", ["n", "variant_get(doc, '$.k', 'int') AS k"], schema="research").first() == (7, 1)
    assert [t["name"] for t in engine.list_tables("research")] == ["t"] and "research" in engine.list_schemas()
    assert any(x["name"] == "lab" for x in engine.list_databases())
    with pytest.raises(ValueError):
        engine.create_database("lab")


def test_refusals(engine):
    engine.create_table("u", {"id": "SERIAL PRIMARY KEY", "name": "VARCHAR(5) NOT NULL", "mail": "TEXT UNIQUE"}, "research")
    engine.insert("u", {"name": "a", "mail": "x"}, "research")
    for bad in ({"name": None, "mail": "y"}, {"name": "b", "mail": "x"}, [{"name": "c"}, {"mail": "z"}], {}, {"nothing": 1}):
        with pytest.raises(ValueError):
            engine.insert("u", bad, "research")
    assert engine.insert("u", [], "research") is None and engine.count("u", schema="research") == 1
    for call in (lambda: engine.update("u", {"name": "q"}, {}, "research"), lambda: engine.update("u", {}, {"id": 1}, "research"), lambda: engine.delete("u", {}, "research")):
        with pytest.raises(ValueError):
            call()


def test_marks():
    assert bind_marks("a = %s AND b LIKE '%%x' AND c = '%s'", (1,)) == ("a = ? AND b LIKE '%x' AND c = '%s'", [1])
    assert bind_marks("a = %(x)s", {"x": 1}) == ("a = :x", {"x": 1})
    assert bind_marks("a LIKE '%%'", None) == ("a LIKE '%%'", None)


def test_definitions():
    s = column_spec("a", "VARCHAR(50) NOT NULL")
    assert (s.type, s.not_null) == ("VARCHAR(50)", True)
    assert column_spec("a", "FLOAT").type == "DOUBLE" and column_spec("a", "NUMERIC").type == "DECIMAL(38,18)" and column_spec("a", "NUMERIC(8, 2)").type == "DECIMAL(8,2)"
    assert column_spec("a", "INTEGER[]").type == "ARRAY<INT>" and column_spec("a", "timestamp with time zone").type == "TIMESTAMP"
    with pytest.raises(ValueError):
        column_spec("a", "GEOMETRY")
    assert split_list("a, f(b, c) DESC, 'x,y'") == ["a", "f(b, c) DESC", "'x,y'"]
    assert pretty_size(8192) == "8192 bytes" and pretty_size(16384) == "16 kB"


def test_null_order_and_filters(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 4)], "k int, v int")
    keys = lambda by: [r["k"] for r in df.orderBy(*ordering(by)).collect()]
    assert keys("v") == [3, 2, 1] and keys("v DESC") == [1, 2, 3] and keys("v DESC NULLS LAST") == [2, 3, 1]
    assert R.count(df, {"v": None}).first()["n"] == 0
    assert R.select(df, limit=0).count() == 3 and R.select(df, where={}).count() == 3
    assert R.deleted(df, F.col("v") == 4).count() == 2
    assert [r["v"] for r in R.updated(df, {"v": F.lit(0)}, F.col("v") == 5).orderBy("k").collect()] == [None, 0, 4]


def test_resample_edges(spark):
    df = spark.createDataFrame([("2024-01-01 01:00:00", 1.0), ("2024-01-03 02:00:00", 3.0), (None, 9.0)], "t string, v double").withColumn("t", F.to_timestamp_ntz("t"))
    assert [r["v"] for r in T.resample_mean(df, "t", ["v"]).orderBy("bin").collect()] == [1.0, None, 3.0]
    assert T.resample_mean(df.where("false"), "t", ["v"]).count() == 0
    assert sum(r["n"] for r in T.resample_size(df, "t").collect()) == 2
    assert [r["chunk"] for r in T.time_chunks(df, "t", "2024-01-01", "2024-01-04", 2).orderBy("t").collect()] == [0, 1]


def test_streaming_resample(spark, tmp_path):
    from helioframe.streaming.resample import streaming_resample

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    events.write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming_resample(source, "ts", ["value"], "1 day").writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bins").agg(F.sum("n")).first()[0] == events.count()


def test_settings(tmp_path, monkeypatch):
    for v in ("DB_HOST", "DB_PORT", "DB_NAME", "DB_DATABASE", "DB_USER", "DB_PASSWORD", "DB_LOG_QUERIES"):
        monkeypatch.delenv(v, raising=False)
    (tmp_path / "c.json").write_text(json.dumps({"database": {"host": "h", "user": "u"}}))
    (tmp_path / "e.yaml").write_text("")
    (tmp_path / "x.ini").write_text("")
    assert config.load_config()["database"] == config.DEFAULTS
    monkeypatch.setenv("DB_HOST", "env")
    monkeypatch.setenv("DB_PORT", "1")
    monkeypatch.setenv("DB_DATABASE", "b")
    monkeypatch.setenv("DB_NAME", "a")
    monkeypatch.setenv("DB_USER", "")
    got = config.load_config(str(tmp_path / "c.json"))["database"]
    assert got == {"host": "env", "port": 1, "log_queries": False, "user": "u", "database": "a"}
    assert config.load_config(str(tmp_path / "e.yaml"))["database"]["host"] == "env"
    with pytest.raises(ValueError):
        config.load_config(str(tmp_path / "x.ini"))
    with pytest.raises(FileNotFoundError):
        config.load_config(str(tmp_path / "none.json"))
    with pytest.raises(ValueError):
        config.from_dict({"host": "h"})
    made = config.create_example_config(str(tmp_path / "example.yaml"))
    assert config.from_file(made)["database"]["port"] == 5432


def test_first_rows_of_lateral_subqueries(spark):
    """The rows of an outer row are numbered in their order, not as an exchange happens to bring them."""
    e = Engine(spark, database="lateral")
    e.view("a", spark.createDataFrame([(1,), (2,), (3,), (1,), (None,)], "k long"))
    e.view("b", spark.createDataFrame([(1, 10, 1.0), (1, 11, 2.0), (1, 12, 3.0), (2, 20, 5.0), (2, 21, 5.0), (None, 1, 1.0), (1, 13, None)], "k long, v long, p double"))
    rows = {
        "SELECT v AS x FROM b WHERE b.k = a.k ORDER BY p DESC, v LIMIT 2": [(1, 11), (1, 11), (1, 12), (1, 12), (2, 20), (2, 21)],
        "SELECT v AS x FROM b WHERE b.k = a.k ORDER BY p DESC, v LIMIT 1 OFFSET 1": [(1, 11), (1, 11), (2, 21)],
        "SELECT -v AS x FROM b WHERE b.k = a.k ORDER BY x LIMIT 1": [(1, -13), (1, -13), (2, -21)],
        "SELECT v AS x FROM b WHERE b.k = a.k ORDER BY 1 DESC LIMIT 1": [(1, 13), (1, 13), (2, 21)],
        "SELECT DISTINCT p AS x FROM b WHERE b.k = a.k ORDER BY x DESC LIMIT 1": [(1, 3.0), (1, 3.0), (2, 5.0)],
    }
    for inner, expected in rows.items():
        found = e.sql(f"SELECT a.k, t.x FROM a, LATERAL ({inner}) t")
        assert sorted(tuple(r) for r in found.collect()) == expected
        windows = re.findall(r"windowspecdefinition\((.*?)specifiedwindowframe", found._jdf.queryExecution().optimizedPlan().toString())
        assert windows and all(" ASC " in w or " DESC " in w for w in windows)
    with pytest.raises(ValueError, match="LATERAL"):
        e.sql("SELECT a.k, t.p FROM a, LATERAL (SELECT DISTINCT p FROM b WHERE b.k = a.k ORDER BY 1 LIMIT 1) t")
    e.close()
    e.drop_database("lateral")


def test_rows_one_by_one(spark, monkeypatch, tmp_path):
    """A stream of rows is never collected whole; the query over it takes no rows, nulls and NaN."""
    from helioframe.changes import q62_execute_rows

    e = Engine(spark, database="stream")
    e.view("many", spark.range(0, 20_000, 1, 8))
    rows = e.execute("SELECT id, id * 2 AS d FROM many WHERE id >= %s", (5,), fetch=True, stream=True)
    with monkeypatch.context() as m:
        m.setattr(type(spark.range(1)), "collect", lambda self: pytest.fail("collected"))
        assert next(rows) == {"id": 5, "d": 10} and sum(1 for _ in rows) == 19_994
        assert next(e.execute("SELECT id FROM many", fetch=True, dict_cursor=False, stream=True)) == (0,)
    e.close()
    e.drop_database("stream")
    for at, (prices, expected) in enumerate([([], (0, 0, None)), ([None], (1, 1, None)), ([1.0, None, 3.0], (3, 3, 3.0)), ([1.0, float("nan"), 3.0], (3, 3, None))]):
        spark.createDataFrame([(i, "P", p) for i, p in enumerate(prices)], "o_orderkey long, o_orderstatus string, o_totalprice double").write.parquet(f"{tmp_path}/{at}/orders.parquet")
        found = tuple(q62_execute_rows(spark, f"{tmp_path}/{at}").first())
        assert tuple(None if x != x else x for x in found) == expected
