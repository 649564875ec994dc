"""Queries as text through the engine: joins, windows, set operations, and PostgreSQL's own forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe.changes import engine, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def text(name: str, tables: str, statement: str, oracle: str | None = None, params: object = None) -> None:
    """Registers a statement over tables; `oracle` is what DuckDB runs, where its text differs."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        e = engine(spark)
        for t in tables.split():
            e.view(t, read(spark, sf, t))
        return e.sql(statement, params)

    QUERIES[name], ORACLE_SQL[name] = run, oracle or statement


# Joins

text("q75_left_join", "customer orders", "SELECT c_custkey, count(o_orderkey) AS n, round(coalesce(sum(o_totalprice), 0), 2) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
text("q76_full_join", "supplier customer", "SELECT coalesce(s.k, c.k) AS k, s.n AS suppliers, c.n AS customers FROM (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey < 15 GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_nationkey > 5 GROUP BY c_nationkey) c ON s.k = c.k")
text("q77_semi_join", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
text("q78_anti_join", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
text("q79_range_join", "events nation", "SELECT n_nationkey, count(event_id) AS n FROM nation LEFT JOIN events ON value BETWEEN n_nationkey * 10 AND n_nationkey * 10 + 4.5 GROUP BY n_nationkey")
text("q80_cross_join", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation WHERE r_regionkey = n_regionkey OR n_nationkey = 0")
_AS_OF = "SELECT event_id, ts, user_id, value FROM events WHERE event_type = '{}'"
text("q81_asof_join", "events",
     f"SELECT p.event_id, max_by(c.event_id, struct(c.ts, c.event_id)) AS click FROM ({_AS_OF.format('purchase')}) p JOIN ({_AS_OF.format('click')}) c ON c.user_id = p.user_id AND c.ts <= p.ts GROUP BY p.event_id",
     f"SELECT p.event_id, arg_max(c.event_id, (c.ts, c.event_id)) AS click FROM ({_AS_OF.format('purchase')}) p JOIN ({_AS_OF.format('click')}) c ON c.user_id = p.user_id AND c.ts <= p.ts GROUP BY p.event_id")

# Windows, groups, sets

text("q82_ranking", "orders", "SELECT o_custkey, o_orderkey, rank() OVER w AS place, dense_rank() OVER w AS dense, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
text("q83_range_frame", "events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '6' HOUR PRECEDING AND CURRENT ROW) AS n, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS most FROM events")
text("q84_sets", "customer supplier", "(SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer WHERE c_nationkey < 4 EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey = 2)")
text("q85_except_all", "orders", "SELECT o_custkey, o_orderstatus FROM orders WHERE o_custkey < 200 EXCEPT ALL SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
text("q86_grouping_sets", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, grouping(o_orderstatus) AS all_status FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())",
     "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS TINYINT) AS all_status FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
text("q87_cube", "events", "SELECT event_type, date_part('day', ts)::INT AS d, count(*) AS n FROM events WHERE ts < '2024-01-04'::TIMESTAMP GROUP BY CUBE (event_type, date_part('day', ts)::INT)",
     "SELECT event_type, d, count(*) AS n FROM (SELECT event_type, date_part('day', ts)::INT AS d FROM events WHERE ts < '2024-01-04'::TIMESTAMP) GROUP BY CUBE (event_type, d)")
text("q88_filter_cast", "events", "SELECT event_type::STRING AS kind, count(*) FILTER (WHERE value > 50) AS n, sum(value::INT) AS total, max(value)::DECIMAL(20, 2) AS most FROM events WHERE event_type ILIKE 'P%' OR event_type ILIKE '%CK' GROUP BY event_type",
     "SELECT event_type AS kind, count(*) FILTER (WHERE value > 50) AS n, CAST(sum(CAST(trunc(value) AS INTEGER)) AS BIGINT) AS total, CAST(max(value) AS DECIMAL(20, 2)) AS most FROM events WHERE event_type ILIKE 'P%' OR event_type ILIKE '%CK' GROUP BY event_type")
text("q89_lateral", "customer orders", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t WHERE c_nationkey = 3")
text("q90_recursive", "region", "WITH RECURSIVE f(n, a, b) AS (SELECT 1, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, b, a + b FROM f WHERE n < 40) SELECT n, a FROM f")
text("q91_interval", "events", "SELECT count(*) AS n FROM events WHERE ts > TIMESTAMP '2024-01-30 00:00:00' - INTERVAL '3 days' AND ts < TIMESTAMP '2024-01-30 00:00:00'")
text("q92_any_value", "nation region", "SELECT r_name, count(*) AS n, string_agg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name HAVING count(*) > 1",
     "SELECT r_name, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name HAVING count(*) > 1")

# PostgreSQL's own forms

text("q93_regex_match", "customer", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment ~ '^(BUILD|AUTO)' AND c_name !~ '7$' AND c_name ~* 'CUSTOMER' AND c_mktsegment !~~ '%X%'",
     "SELECT c_custkey, c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '^(BUILD|AUTO)') AND NOT regexp_matches(c_name, '7$') AND regexp_matches(c_name, 'CUSTOMER', 'i') AND c_mktsegment NOT LIKE '%X%'")
text("q94_distinct_on", "orders", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus = %(status)s ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
     "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice AS price FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey, o_totalprice DESC, o_orderkey", {"status": "F"})
text("q95_generate_series", "nation", "SELECT s.x, n_name FROM generate_series(2, 6) AS s(x) JOIN nation ON n_nationkey = s.x UNION ALL SELECT x, 'none' FROM generate_series(5, 4) AS t(x)",
     "SELECT CAST(s.x AS INTEGER) AS x, n_name FROM generate_series(2, 6) AS s(x) JOIN nation ON n_nationkey = s.x")
text("q96_series_of_days", "region", "SELECT generate_series(TIMESTAMP_NTZ '2024-01-30 00:00:00', TIMESTAMP_NTZ '2024-03-02 00:00:00', INTERVAL '1' DAY) AS d",
     "SELECT unnest(generate_series(TIMESTAMP '2024-01-30 00:00:00', TIMESTAMP '2024-03-02 00:00:00', INTERVAL 1 DAY)) AS d")
text("q97_integer_division", "orders", "SELECT o_orderkey, o_orderkey DIV 7 AS q, o_orderkey % 7 AS r FROM orders", "SELECT o_orderkey, o_orderkey // 7 AS q, o_orderkey % 7 AS r FROM orders")


def q98_information_schema(spark: SparkSession, sf: str) -> DataFrame:
    """Tables and columns of the engine's database, as the standard's views show them."""
    e = engine(spark)
    e.create_schema("lab")
    e.create_table("shelf", {"id": "SERIAL PRIMARY KEY", "name": "VARCHAR(20)", "n": "INTEGER DEFAULT 7"}, "lab")
    e.create_table("box", {"x": "TEXT"})
    return e.sql("SELECT c.table_schema, c.table_name, c.column_name, c.ordinal_position, c.is_nullable, c.column_default, t.table_type FROM information_schema.columns c JOIN information_schema.tables t ON t.table_schema = c.table_schema AND t.table_name = c.table_name JOIN information_schema.schemata s ON s.schema_name = c.table_schema WHERE c.table_name = %s OR c.ordinal_position = 1", ("shelf",))


QUERIES["q98_information_schema"] = q98_information_schema
ORACLE_SQL["q98_information_schema"] = "SELECT * FROM (VALUES ('lab', 'shelf', 'id', 1, 'NO', NULL, 'BASE TABLE'), ('lab', 'shelf', 'name', 2, 'YES', NULL, 'BASE TABLE'), ('lab', 'shelf', 'n', 3, 'YES', '7', 'BASE TABLE'), ('public', 'box', 'x', 1, 'YES', NULL, 'BASE TABLE')) AS t(table_schema, table_name, column_name, ordinal_position, is_nullable, column_default, table_type)"


def q99_describe_approximate(spark: SparkSession, sf: str) -> DataFrame:
    """Quartiles from bounded sketches: their ranks are off by a hundredth at most."""
    from helioframe.operators import timeseries as T

    events = read(spark, sf, "events")
    found = T.describe(events, "value", approximate=10_000)
    rank = events.join(F.broadcast(found)).agg(F.count("*").alias("n"), *[F.abs(F.avg((F.col("value") <= F.col(q)).cast("int")) - at).alias(q) for q, at in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75))])
    return rank.select("n", *[(F.col(q) < 0.01).alias(q) for q in ("q25", "q50", "q75")])


QUERIES["q99_describe_approximate"] = q99_describe_approximate
ORACLE_SQL["q99_describe_approximate"] = "SELECT count(*) AS n, true AS q25, true AS q50, true AS q75 FROM events"
