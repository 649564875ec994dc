"""Queries that run the engine itself: changes of tables, definitions and listings, settings, sinks and downloads."""

from __future__ import annotations

import atexit
import json
import logging
import os
import tempfile
import threading
import uuid
from collections.abc import Callable
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.operators.engine import Engine
from helioframe.plans.text import pretty_size
from helioframe.sources import config, download, jdbc, links

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _drop(e: Engine) -> None:
    try:
        e.drop_database(e.database)
    except Exception:  # the session may be gone; its catalog then is, too
        pass


def engine(spark: SparkSession) -> Engine:
    """An engine on a database of its own, dropped when the driver ends."""
    e = Engine(spark, database=f"q{uuid.uuid4().hex[:10]}")
    atexit.register(_drop, e)
    return e


def _facts(spark: SparkSession, facts: dict[str, object]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in facts.items()], "fact string, value string")


def _values(facts: dict[str, object]) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in facts.items())
    return f"SELECT * FROM (VALUES {rows}) AS t(fact, value)"


SHELF = {"id": "SERIAL PRIMARY KEY", "name": "VARCHAR(20) NOT NULL", "n": "INTEGER DEFAULT 7", "score": "FLOAT"}


# Rows


@query("SELECT 1::INTEGER AS id, 'a' AS name, 7::INTEGER AS n, 1.5::DOUBLE AS score UNION ALL SELECT 2, 'b', 9, NULL")
def q53_insert_one(spark, sf):
    e = engine(spark)
    e.create_table("shelf", SHELF)
    e.insert("shelf", {"name": "a", "score": 1.5})
    e.insert("shelf", {"name": "b", "n": 9})
    return e.select("shelf")


@query("SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS INTEGER) AS id, r_name AS name, CAST(r_regionkey AS INTEGER) AS n, CAST(NULL AS DOUBLE) AS score FROM region")
def q54_insert_many(spark, sf):
    e = engine(spark)
    e.create_table("shelf", SHELF)
    e.insert("shelf", [{"name": r["r_name"], "n": r["r_regionkey"]} for r in read(spark, sf, "region").orderBy("r_regionkey").collect()])
    return e.select("shelf")


@query("SELECT count(*) AS n, 1::BIGINT AS first_id, count(*) AS last_id, count(*) AS ids, round(sum(o_totalprice), 2) AS total, count(*) AS noted FROM orders")
def q55_insert_frame(spark, sf):
    """A frame of several partitions: serial numbers without gaps, defaults, one job."""
    e = engine(spark)
    e.create_table("sales", {"id": "BIGSERIAL", "o_orderkey": "BIGINT NOT NULL", "price": "FLOAT", "note": "TEXT DEFAULT 'new'"})
    e.insert("sales", read(spark, sf, "orders").repartition(5).select("o_orderkey", F.col("o_totalprice").alias("price")))
    return e.table("sales").agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count_distinct("id").alias("ids"), F.round(F.sum("price"), 2).alias("total"), F.count_if(F.col("note") == "new").alias("noted"))


@query("SELECT * FROM (VALUES (1, 1), (2, 2), (3, 5)) AS t(nth, id)")
def q56_return_id(spark, sf):
    e = engine(spark)
    e.create_table("shelf", SHELF)
    ids = [e.insert("shelf", {"name": "a"}, return_id=True), e.insert("shelf", {"name": "b"}, return_id=True)]
    e.insert("shelf", [{"name": "c"}, {"name": "d"}], return_id=True)
    ids.append(e.insert("shelf", {"name": "e"}, return_id=True))
    return spark.createDataFrame(list(enumerate(ids, 1)), "nth int, id int")


def _suppliers(spark: SparkSession, sf: str) -> Engine:
    e = engine(spark)
    e.create_table("supplier", {"s_suppkey": "BIGINT PRIMARY KEY", "s_nationkey": "INTEGER", "s_acctbal": "FLOAT"})
    e.insert("supplier", read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))
    return e


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal, (SELECT count(*) FROM supplier WHERE s_nationkey = 3) AS updated FROM supplier")
def q57_update(spark, sf):
    e = _suppliers(spark, sf)
    updated = e.update("supplier", {"s_acctbal": 0.0}, {"s_nationkey": 3})
    return e.select("supplier", ["s_suppkey", "s_acctbal", f"{updated}L AS updated"])


@query("SELECT s_suppkey, (SELECT count(*) FROM supplier WHERE s_nationkey = 4) AS deleted FROM supplier WHERE s_nationkey <> 4 OR s_nationkey IS NULL")
def q58_delete(spark, sf):
    e = _suppliers(spark, sf)
    deleted = e.delete("supplier", {"s_nationkey": 4})
    return e.select("supplier", ["s_suppkey", f"{deleted}L AS deleted"])


@query("SELECT count(*) AS before, 0::BIGINT AS left_over, count(*) AS again FROM supplier")
def q59_truncate(spark, sf):
    e = _suppliers(spark, sf)
    before = e.count("supplier")
    e.truncate("supplier")
    left_over = e.count("supplier")
    e.insert("supplier", read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"))
    return spark.createDataFrame([(before, left_over, e.count("supplier"))], "before long, left_over long, again long")


@query("SELECT s_suppkey, CASE WHEN s_acctbal < 0 OR s_nationkey IN (1, 2) THEN s_acctbal * 2 + s_nationkey ELSE s_acctbal END AS s_acctbal, (SELECT count(*) FROM supplier WHERE s_acctbal < 0 OR s_nationkey IN (1, 2)) AS updated FROM supplier")
def q60_update_expression(spark, sf):
    e = _suppliers(spark, sf)
    updated = e.update_expr("supplier", {"s_acctbal": "s_acctbal * 2 + s_nationkey"}, "s_acctbal < 0 OR s_nationkey IN (1, 2)")
    return e.select("supplier", ["s_suppkey", "s_acctbal", f"{updated}L AS updated"])


REFUSED = {"null": True, "duplicate": True, "other columns": True, "no columns": True, "unknown column": True, "update without where": True, "update without data": True, "delete without where": True, "empty list": None, "rows": 1}


@query(_values(REFUSED))
def q61_refusals(spark, sf):
    e = engine(spark)
    e.create_table("u", {"id": "SERIAL PRIMARY KEY", "name": "VARCHAR(5) NOT NULL", "mail": "TEXT UNIQUE"})
    e.insert("u", {"name": "a", "mail": "x"})

    def refused(call: Callable[[], object]) -> bool:
        try:
            call()
        except ValueError:
            return True
        return False

    rows = {"null": {"name": None, "mail": "y"}, "duplicate": {"name": "b", "mail": "x"}, "other columns": [{"name": "c"}, {"mail": "z"}], "no columns": {}, "unknown column": {"nothing": 1}}
    facts: dict[str, object] = {k: refused(lambda v=v: e.insert("u", v)) for k, v in rows.items()}
    facts |= {"update without where": refused(lambda: e.update("u", {"name": "q"}, {})), "update without data": refused(lambda: e.update("u", {}, {"id": 1})), "delete without where": refused(lambda: e.delete("u", {}))}
    return _facts(spark, facts | {"empty list": e.insert("u", []), "rows": e.count("u")})


@query("SELECT count(*) AS fetched, count(*) AS counted, max(o_totalprice) AS most FROM orders WHERE o_orderstatus = 'P'")
def q62_execute_rows(spark, sf):
    """Rows as dicts and as tuples, one by one; a statement that is not fetched gives none."""
    e = engine(spark)
    e.view("orders_now", read(spark, sf, "orders"))
    text = "SELECT o_orderkey, o_totalprice FROM orders_now WHERE o_orderstatus = %s"
    if e.execute(text, ("P",)) is not None:
        raise ValueError("rows were fetched")
    counts, most = [], None
    for dict_cursor, price in ((True, "o_totalprice"), (False, 1)):
        n = 0
        for n, row in enumerate(e.execute(text, ("P",), fetch=True, dict_cursor=dict_cursor, stream=True), 1):
            if (x := row[price]) is not None and (most is None or x > most or x != x):  # NaN is the most
                most = x
        counts.append(n)
    out = spark.createDataFrame([(*counts, most)], "fetched long, counted long, most double")
    e.close()
    return out


# Databases, schemas, tables

DATABASES = {"made": True, "sized": True, "twice": "refused", "dropped": True, "files gone": True, "unknown": "refused"}


@query(_values(DATABASES))
def q63_databases(spark, sf):
    e, other = engine(spark), f"q{uuid.uuid4().hex[:10]}"
    e.create_database(other)
    with Engine(spark, database=other) as o:
        o.create_table("t", {"id": "SERIAL", "name": "TEXT"})
        o.insert("t", {"name": "x"})
        at = o._location("t", None)
    known = {d["name"]: d["size"] for d in e.list_databases()}

    def refused(call: Callable[[], object]) -> str:
        try:
            call()
        except ValueError:
            return "refused"
        return "done"

    twice = refused(lambda: e.create_database(other))
    e.drop_database(other, force=True)
    return _facts(spark, {"made": other in known, "sized": known[other] != "0 bytes", "twice": twice, "dropped": other not in {d["name"] for d in e.list_databases()}, "files gone": e._bytes(at) == 0, "unknown": refused(lambda: e.drop_database(other))})


SCHEMAS = {"listed": "[lab, public]", "again": "[lab, public]", "not empty": "refused", "cascade": "[public]", "files gone": True}


@query(_values(SCHEMAS))
def q64_schemas(spark, sf):
    e = engine(spark)
    show = lambda: "[" + ", ".join(e.list_schemas()) + "]"
    e.create_schema("lab")
    facts: dict[str, object] = {"listed": show()}
    e.create_schema("lab")
    facts["again"] = show()
    e.create_table("t", {"id": "SERIAL", "name": "TEXT"}, "lab")
    e.insert("t", {"name": "x"}, "lab")
    at = e._location("t", "lab")
    try:
        e.drop_schema("lab")
        facts["not empty"] = "dropped"
    except Exception:
        facts["not empty"] = "refused"
    e.drop_schema("lab", cascade=True)
    return _facts(spark, facts | {"cascade": show(), "files gone": e._bytes(at) == 0})


TABLES = {"listed": "[t, t2]", "exists": True, "unknown": False, "view exists": True, "sized": True, "views left": "[over_t2]", "dropped": "[t2]", "dropped twice": True}


@query(_values(TABLES))
def q65_tables(spark, sf):
    """Listings, and a cascade that takes the views of the table and no others with it."""
    e = engine(spark)
    for t in ("t", "t2"):
        e.create_table(t, {"id": "SERIAL", "name": "TEXT"})
        e.create_table(t, {"other": "TEXT"})  # exists: nothing happens
        e.insert(t, {"name": "t"})
    space = e._space(None)
    spark.sql(f"CREATE VIEW {space}.over_t AS SELECT id FROM {space}.t2 WHERE id IN (SELECT id FROM {space}.t)")
    spark.sql(f"CREATE VIEW {space}.over_t2 AS SELECT id AS t FROM {space}.t2")
    facts: dict[str, object] = {"listed": f"[{', '.join(e.list_tables(names_only=True))}]", "exists": e.table_exists("t"), "unknown": e.table_exists("none"), "view exists": e.table_exists("over_t"), "sized": all(x["size"].endswith("bytes") and x["size"] != "0 bytes" for x in e.list_tables())}
    e.drop_table("t", cascade=True)
    facts["views left"] = f"[{', '.join(r['viewName'] for r in spark.sql(f'SHOW VIEWS IN {space}').collect() if not r['isTemporary'])}]"
    facts["dropped"] = f"[{', '.join(e.list_tables(names_only=True))}]"
    return _facts(spark, facts | {"dropped twice": e.drop_table("t") is None})


@query("SELECT * FROM (VALUES ('id', 'int', NULL::INTEGER, 'NO', NULL::VARCHAR), ('name', 'varchar(20)', 20, 'NO', NULL), ('n', 'int', NULL, 'YES', '7'), ('score', 'double', NULL, 'YES', NULL)) AS t(column_name, data_type, max_length, is_nullable, default_value)")
def q66_describe_table(spark, sf):
    e = engine(spark)
    e.create_table("shelf", SHELF)
    if e.describe_table("none"):
        raise ValueError("an unknown table has columns")
    return spark.createDataFrame([tuple(c.values()) for c in e.describe_table("shelf")], "column_name string, data_type string, max_length int, is_nullable string, default_value string")


@query("SELECT 3::BIGINT AS versions, 1::BIGINT AS left_over, count(*) AS n, count(*) AS known FROM supplier")
def q67_vacuum(spark, sf):
    """Old versions go, rows stay, and the statistics know their number."""
    e = _suppliers(spark, sf)
    e.update("supplier", {"s_acctbal": 1.0}, {"s_nationkey": 3})
    e.update_expr("supplier", {"s_acctbal": "s_acctbal + 1"}, "true")
    fs, at = e._fs(e._root("supplier", None))
    versions = lambda: sum(f.isDirectory() for f in fs.listStatus(at))
    before = versions()
    e.vacuum("supplier")
    known = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {e._name('supplier', None)}").collect()}["Statistics"]
    return spark.createDataFrame([(before, versions(), e.count("supplier"), int(known.split(", ")[1].split()[0]))], "versions long, left_over long, n long, known long")


SIZES = {0: "0 bytes", 8192: "8192 bytes", 10239: "10239 bytes", 10240: "10 kB", 16384: "16 kB", 10485247: "10239 kB", 10485760: "10 MB", 5 << 40: "5120 GB", 20 << 40: "20 TB"}


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}::BIGINT, '{v}')" for k, v in SIZES.items()) + ") AS t(n, size)")
def q68_pretty_size(spark, sf):
    return spark.createDataFrame([(n, pretty_size(n)) for n in SIZES], "n long, size string")


@query("SELECT count(*) AS before, 0::BIGINT AS orders_left, 0::BIGINT AS lines_left, true AS refused FROM region")
def q69_truncate_cascade(spark, sf):
    e = engine(spark)
    e.create_table("regions", {"id": "INTEGER PRIMARY KEY", "name": "TEXT"})
    e.create_table("places", {"id": "SERIAL PRIMARY KEY", "region": "INTEGER REFERENCES regions(id)"})
    e.insert("regions", read(spark, sf, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    e.insert("places", [{"region": 1}, {"region": 2}])
    before = e.count("regions")
    try:
        e.truncate("regions")
        refused = False
    except ValueError:
        refused = True
    e.truncate("regions", cascade=True)
    return spark.createDataFrame([(before, e.count("regions"), e.count("places"), refused)], "before long, orders_left long, lines_left long, refused boolean")


# Settings, sessions

SETTINGS = {"default": "localhost:5432", "file": "filehost:5432", "environment": "envhost:1", "empty variable": "filehost", "missing file": "FileNotFoundError", "other kind": "ValueError", "missing keys": "ValueError", "dict": "h", "example": 5432}


@query(_values(SETTINGS))
def q70_settings(spark, sf):
    """Environment over file over defaults; files of known kinds only; what must be there."""
    was = {k: os.environ.pop(k) for k in list(os.environ) if k.startswith("DB_")}
    try:
        with tempfile.TemporaryDirectory() as here:
            path = os.path.join(here, "c.json")
            with open(path, "w") as f:
                json.dump({"database": {"host": "filehost"}}, f)
            show = lambda c: f"{c['database']['host']}:{c['database']['port']}"

            def failed(call: Callable[[], object]) -> str:
                try:
                    return str(call())
                except (FileNotFoundError, ValueError) as error:
                    return type(error).__name__

            facts: dict[str, object] = {"default": show(config.load_config()), "file": show(config.load_config(path))}
            os.environ |= {"DB_HOST": "envhost", "DB_PORT": "1"}
            facts["environment"] = show(config.load_config(path))
            os.environ["DB_HOST"] = ""
            facts["empty variable"] = config.load_config(path)["database"]["host"]
            facts |= {"missing file": failed(lambda: config.load_config(path + ".yaml")), "other kind": failed(lambda: config.from_file(os.path.abspath(__file__))), "missing keys": failed(lambda: config.from_dict({"host": "h"}))}
            facts["dict"] = config.from_dict({"host": "h", "database": "d", "user": "u", "password": "p"})["host"]
            facts["example"] = config.from_file(config.create_example_config(os.path.join(here, "e.yaml")))["database"]["port"]
    finally:
        for k in ("DB_HOST", "DB_PORT"):
            os.environ.pop(k, None)
        os.environ |= was
    return _facts(spark, facts)


SESSION = {"own view dropped": True, "other view kept": True, "schema kept": True, "text logged": True, "values logged": False, "changes logged": 4, "error passes": True, "jdbc": "jdbc:postgresql://h:5432/d"}


@query(_values(SESSION))
def q71_session(spark, sf):
    """Logs of queries and changes without values; what closing an engine leaves alone."""
    lines: list[str] = []
    handler = logging.Handler()
    handler.emit = lambda record: lines.append(record.getMessage())
    log = logging.Logger("session", logging.INFO)
    log.addHandler(handler)
    name, before = f"v{uuid.uuid4().hex[:8]}", spark.catalog.currentDatabase()
    spark.range(1).createOrReplaceTempView(f"{name}_other")
    own = engine(spark).database
    passed = False
    try:
        with Engine(spark, database=own, log_queries=True, logger=log) as e:
            e.create_table("shelf", SHELF)
            e.insert("shelf", {"name": "secret"})
            e.update("shelf", {"n": 1}, {"name": "secret"})
            e.delete("shelf", {"name": "secret"})
            e.truncate("shelf")
            e.execute(f"CREATE TEMPORARY VIEW {name} AS SELECT 1 AS x")
            e.execute("SELECT * FROM shelf WHERE name = %s", ("secret",))
            raise KeyError
    except KeyError:
        passed = True
    found = {t.name for t in spark.catalog.listTables()}
    facts = {"own view dropped": name not in found, "other view kept": f"{name}_other" in found, "schema kept": spark.catalog.currentDatabase() == before, "text logged": any("WHERE name = %s" in x for x in lines)}
    spark.catalog.dropTempView(f"{name}_other")
    facts |= {"values logged": any("secret" in x for x in lines), "changes logged": sum(x.startswith(("insert", "update", "delete", "truncate")) for x in lines), "error passes": passed}
    return _facts(spark, facts | {"jdbc": jdbc.options({"host": "h", "database": "d", "user": "u", "password": "p"}, "t")["url"]})


# Sinks and downloads


@query("SELECT event_id, ts, event_type, value FROM events")
def q72_csv_sink(spark, sf):
    e = engine(spark)
    events = read(spark, sf, "events").select("event_id", "ts", "event_type", "value")
    path = e.write_csv(events, f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/helioframe/{e._space(None)}/events-csv")
    return spark.read.schema(events.schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(path)


class _Server:
    """A small server on this machine, for as long as a query needs one."""

    def __init__(self, pages: dict[str, bytes]) -> None:
        class Handler(BaseHTTPRequestHandler):
            def do_GET(self) -> None:
                found = pages.get(self.path)
                self.send_response(404 if found is None else 200)
                self.end_headers()
                self.wfile.write(found or b"")

            def log_message(self, *args: object) -> None:
                pass

        self.server = HTTPServer(("127.0.0.1", 0), Handler)

    def __enter__(self) -> str:
        threading.Thread(target=self.server.serve_forever, daemon=True).start()
        return f"http://127.0.0.1:{self.server.server_port}"

    def __exit__(self, *error: object) -> None:
        self.server.shutdown()
        self.server.server_close()


@query("SELECT CAST(n_nationkey AS INTEGER) AS pos, n_name || '&co.fits' AS href FROM nation WHERE n_nationkey % 3 = 0")
def q73_file_list(spark, sf):
    """A listing over HTTP: names with entities, other kinds, rooted links, queries and parents among them."""
    kinds = ("{}&amp;co.fits", "{}.txt", "/{}.fits")
    rows = read(spark, sf, "nation").orderBy("n_nationkey").collect()
    html = "\n".join(f'<a href="{kinds[r["n_nationkey"] % 3].format(r["n_name"])}">x</a>' for r in rows) + '<a href="../parent.fits">up</a><a href="x.fits?c=1">sorted</a>'
    with _Server({"/data/": html.encode()}) as url:
        found = links.get_file_list(spark, f"{url}/data", ["fits"]).select("pos", "href").collect()
    return spark.createDataFrame(found, "pos int, href string")


@query("SELECT count(*) AS downloaded, 1::BIGINT AS failed, sum(length(r_name))::BIGINT AS size, true AS single, count(*) AS again FROM region")
def q74_downloads(spark, sf):
    """Files fetched by tasks, one of which is not there; those there are not fetched again."""
    pages = {f"/{r['r_regionkey']}": r["r_name"].encode() for r in read(spark, sf, "region").collect()}
    with tempfile.TemporaryDirectory() as here, _Server(pages) as url:
        tasks = [(url + p, os.path.join(here, "got", p[1:])) for p in [*pages, "/none"]]
        done = download.download_parallel(spark, tasks, max_retries=1, parallel=3, wait=0.01)
        size = sum(os.path.getsize(d) for _, d in tasks if os.path.exists(d))
        single = download.download_single_file(tasks[0][0], os.path.join(here, "one"))
        pages.clear()
        again = download.download_parallel(spark, tasks, max_retries=0, parallel=2)["downloaded"]
    return spark.createDataFrame([(done["downloaded"], done["failed"], size, single, again)], "downloaded long, failed long, size long, single boolean, again long")
