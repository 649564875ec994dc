"""The library's own queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helioframe import changes, texts
from helioframe.functions import images as I
from helioframe.functions.instruments import BANDS, aia_intscale, hmi_intscale
from helioframe.operators import relational as R
from helioframe.operators import timeseries as T
from helioframe.plans.text import bind_marks
from helioframe.sources import links as L

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
S = 8  # an embedding of 64 values is an image of 8 by 8


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r4(c: Column) -> Column:
    return F.round(c, 4)


# Projection, filters, ranges, order


@query("SELECT * FROM nation")
def q01_select_all(spark, sf):
    return R.select(read(spark, sf, "nation"))


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def q02_select_columns(spark, sf):
    return R.select(read(spark, sf, "customer"), ["c_custkey", "c_name", "c_mktsegment"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def q03_select_where_and(spark, sf):
    return R.select(read(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})


@query("SELECT event_id, ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' AND event_type = 'click'")
def q04_date_range_half_open(spark, sf):
    return R.select_date_range(read(spark, sf, "events"), "ts", "2024-01-05", "2024-01-12", ["event_id", "ts", "value"], {"event_type": "click"})


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1996-03-01'")
def q05_date_range_inclusive(spark, sf):
    return R.select_date_range(read(spark, sf, "orders"), "o_orderdate", "1996-01-01", "1996-03-01", ["o_orderkey", "o_orderdate"], inclusive_end=True)


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def q06_date_range_order_limit(spark, sf):
    return R.select_date_range(read(spark, sf, "lineitem"), "l_shipdate", "1996-01-01", "1997-01-01", ["l_orderkey", "l_linenumber", "l_extendedprice"], order_by="l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey", limit=100)


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def q07_order_unprojected(spark, sf):
    return R.select(read(spark, sf, "orders"), ["o_orderkey"], order_by="o_totalprice DESC, o_orderkey", limit=25)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q08_topk(spark, sf):
    return R.select(read(spark, sf, "orders"), ["o_orderkey", "o_totalprice"], order_by="o_totalprice DESC, o_orderkey", limit=10)


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = NULL")
def q09_where_null(spark, sf):
    return R.count(read(spark, sf, "orders"), {"o_orderstatus": None})


@query("SELECT r_regionkey, r_name FROM region")
def q10_limit_zero(spark, sf):
    return R.select(read(spark, sf, "region"), ["r_regionkey", "r_name"], limit=0)


# Aggregation


@query("SELECT count(*) AS n FROM lineitem")
def q11_count(spark, sf):
    return R.count(read(spark, sf, "lineitem"))


@query("SELECT count(*) AS n FROM events WHERE event_type = 'purchase'")
def q12_count_where(spark, sf):
    return R.count(read(spark, sf, "events"), {"event_type": "purchase"})


@query("SELECT event_type, round(avg(value), 4) AS mean FROM events GROUP BY event_type")
def q13_group_avg(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(r4(F.avg("value")).alias("mean"))


@query("SELECT event_type, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def q14_group_count_min_max(spark, sf):
    return read(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT event_type, count(*) AS n FROM events WHERE value > 70 GROUP BY event_type")
def q15_filtered_group(spark, sf):
    return read(spark, sf, "events").where("value > 70").groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT count(value) AS n, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS low, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.75), 4) AS q75, max(value) AS high FROM events")
def q16_describe(spark, sf):
    d = T.describe(read(spark, sf, "events"), "value")
    return d.select("n", r4(F.col("mean")).alias("mean"), r4(F.col("std")).alias("std"), "low", *[r4(F.col(q)).alias(q) for q in ("q25", "q50", "q75")], "high")


# Time series


@query("WITH b AS (SELECT date_trunc('day', ts)::TIMESTAMP AS bin, avg(value) AS v FROM events GROUP BY 1), g AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 DAY)) AS bin FROM b) SELECT g.bin, round(b.v, 4) AS value FROM g LEFT JOIN b ON g.bin = b.bin")
def q17_daily_mean(spark, sf):
    return T.resample_mean(read(spark, sf, "events"), "ts", ["value"]).select("bin", r4(F.col("value")).alias("value"))


@query("WITH b AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS bin, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), g AS (SELECT unnest(generate_series(min(bin), max(bin), INTERVAL 1 HOUR)) AS bin FROM b) SELECT g.bin, coalesce(b.n, 0) AS n FROM g LEFT JOIN b ON g.bin = b.bin")
def q18_hourly_size(spark, sf):
    return T.resample_size(R.select(read(spark, sf, "events"), where={"event_type": "error"}), "ts")


@query("SELECT CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-03')) / 604800000000.0) AS BIGINT) AS chunk, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-29' GROUP BY 1")
def q19_week_chunks(spark, sf):
    return T.time_chunks(read(spark, sf, "events"), "ts", "2024-01-03", "2024-01-29").groupBy("chunk").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("SELECT count(*) AS n FROM events WHERE value > 100")
def q20_threshold_events(spark, sf):
    return R.count(read(spark, sf, "events").where("value > 100"))


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'P') AS found")
def q21_exists(spark, sf):
    return R.exists(read(spark, sf, "orders"), {"o_orderstatus": "P"})


# SQL with parameters, parsing


def _run(spark: SparkSession, sf: str, names: tuple[str, ...], text: str, params) -> DataFrame:
    for n in names:
        read(spark, sf, n).createOrReplaceTempView(n)
    query, args = bind_marks(text, params)
    return spark.sql(query, args=args) if args is not None else spark.sql(query)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'")
def q22_execute_params(spark, sf):
    return _run(spark, sf, ("customer",), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > %s AND c_mktsegment = %s", (9000, "BUILDING"))


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'F' GROUP BY n_name")
def q23_execute_join_group(spark, sf):
    text = "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = %(status)s GROUP BY n_name"
    return _run(spark, sf, ("orders", "customer", "nation"), text, {"status": "F"})


@query("SELECT event_id, ts, CAST(strftime(ts, '%Y-%m-%d %H:%M:%S') AS TIMESTAMP) AS parsed FROM events")
def q24_parse_dates(spark, sf):
    return R.parse_dates(read(spark, sf, "events").select("event_id", "ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("parsed")), ["parsed", "no such column"])


@query("SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k FROM events")
def q25_json_field(spark, sf):
    return read(spark, sf, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


# Changes


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier")
def q26_update_view(spark, sf):
    return R.updated(read(spark, sf, "supplier"), {"s_acctbal": F.lit(0.0)}, R.equalities({"s_nationkey": 3})).select("s_suppkey", "s_acctbal")


@query("SELECT p_partkey, p_brand FROM part WHERE p_size <> 10 OR p_size IS NULL")
def q27_delete_view(spark, sf):
    return R.deleted(read(spark, sf, "part"), R.equalities({"p_size": 10})).select("p_partkey", "p_brand")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 100, 'NEW' UNION ALL SELECT 101, NULL")
def q28_insert_union(spark, sf):
    return read(spark, sf, "region").unionByName(spark.createDataFrame([(100, "NEW"), (101, None)], "r_regionkey int, r_name string"))


@query("SELECT 3::BIGINT AS inserted, 1::BIGINT AS flares, 1::BIGINT AS updated, 9.0::DOUBLE AS intensity, 1::BIGINT AS deleted, 2::BIGINT AS remaining")
def q29_demo_flow(spark, sf):
    """Rows of a small table inserted, counted, changed and removed, with the counts that each step gives."""
    e = changes.engine(spark)
    e.create_table("solar_events", {"id": "SERIAL PRIMARY KEY", "event_type": "VARCHAR(50) NOT NULL", "start_time": "TIMESTAMP NOT NULL", "intensity": "FLOAT", "created_at": "TIMESTAMP DEFAULT NOW()"})
    e.insert("solar_events", {"event_type": "solar_flare", "start_time": "2025-01-15 10:30:00", "intensity": 8.5})
    e.insert("solar_events", [{"event_type": "CME", "start_time": "2025-01-16 14:20:00", "intensity": 7.2}, {"event_type": "solar_wind", "start_time": "2025-01-17 08:15:00", "intensity": 5.8}])
    inserted, flares = e.count("solar_events"), e.count("solar_events", {"event_type": "solar_flare"})
    updated = e.update("solar_events", {"intensity": 9.0}, {"event_type": "solar_flare"})
    intensity = e.select("solar_events", ["intensity"], {"event_type": "solar_flare"}).first()[0]
    deleted = e.delete("solar_events", {"event_type": "solar_wind"})
    return spark.createDataFrame([(inserted, flares, updated, intensity, deleted, e.count("solar_events"))], "inserted long, flares long, updated long, intensity double, deleted long, remaining long")


# Images


def _images(spark: SparkSession, sf: str, scale: float = 1.0, shift: float = 0.0) -> DataFrame:
    data = F.transform("embedding", lambda v: v.cast("double") * scale + shift)
    return read(spark, sf, "embeddings").select("vec_id", I.image(data, S, S).alias("img"))


def _long(df: DataFrame, img: Column, kind: str = "double", digits: int | None = None) -> DataFrame:
    out = df.select("vec_id", img["data"].alias("data")).select("vec_id", F.posexplode("data").alias("i", "v"))
    return out.select("vec_id", F.col("i").cast("int").alias("i"), (F.round("v", digits) if digits else F.col("v")).cast(kind).alias("v"))


_PIX = "px AS (SELECT vec_id, CAST(unnest(range(64)) AS INTEGER) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)"


@query(f"WITH {_PIX}, r AS (SELECT vec_id, min(x) AS a, max(x) AS b FROM px GROUP BY vec_id) SELECT vec_id, i, CAST(floor(greatest(0.0, least(255.0, (x - a) / (b - a) * 255.0 + 0.0))) AS INTEGER) AS v FROM px JOIN r USING (vec_id)")
def q30_bytescale_auto(spark, sf):
    return _long(_images(spark, sf), I.bytescale_image(F.col("img")), "int")


@query(f"WITH {_PIX} SELECT vec_id, i, CAST(floor(greatest(10.0, least(200.0, (x - (-0.2)) / (0.3 - (-0.2)) * 190.0 + 10.0))) AS INTEGER) AS v FROM px")
def q31_bytescale_range(spark, sf):
    return _long(_images(spark, sf), I.bytescale_image(F.col("img"), -0.2, 0.3, 10, 200), "int")


def _mask(spark: SparkSession, mask: Column) -> DataFrame:
    return spark.range(1).select(F.posexplode(mask).alias("i", "m")).select(F.col("i").cast("int").alias("i"), "m")


def _mask_sql(test: str) -> str:
    return f"WITH g AS (SELECT CAST(unnest(range(64)) AS INTEGER) AS i), d AS (SELECT i, sqrt(((i // 8) - 4.0) * ((i // 8) - 4.0) + ((i % 8) - 4.0) * ((i % 8) - 4.0)) AS d FROM g) SELECT i, {test} AS m FROM d"


@query(_mask_sql("d < 3"))
def q32_circle_inner(spark, sf):
    return _mask(spark, I.circle_mask(S, 3))


@query(_mask_sql("d >= 3"))
def q33_circle_outer(spark, sf):
    return _mask(spark, I.circle_mask((S, S), 3, mask_type="outer"))


@query(_mask_sql("d >= 1.5 AND d < 3.5"))
def q34_annulus(spark, sf):
    return _mask(spark, I.annulus_mask(S, 1.5, 3.5))


def _moved_sql(h: int, w: int, top: int, left: int, fill: float = 0.0) -> str:
    return f"WITH {_PIX}, g AS (SELECT CAST(unnest(range({h * w})) AS INTEGER) AS j), v AS (SELECT vec_id FROM embeddings) SELECT v.vec_id, j AS i, coalesce(x, {fill}::DOUBLE) AS v FROM v CROSS JOIN g LEFT JOIN px ON px.vec_id = v.vec_id AND (j // {w}) - ({top}) BETWEEN 0 AND 7 AND (j % {w}) - ({left}) BETWEEN 0 AND 7 AND px.i = ((j // {w}) - ({top})) * 8 + (j % {w}) - ({left})"


@query(_moved_sql(11, 10, 1, 1))
def q35_pad_center(spark, sf):
    return _long(_images(spark, sf), I.pad_image(F.col("img"), (11, 10)))


@query(_moved_sql(11, 10, 0, 0, 7.5))
def q36_pad_topleft(spark, sf):
    return _long(_images(spark, sf), I.pad_image(F.col("img"), (11, 10), 7.5, center=False))


@query(_moved_sql(5, 5, -1, -1))
def q37_crop_center(spark, sf):
    return _long(_images(spark, sf), I.crop_or_pad(F.col("img"), (5, 5)))


@query(_moved_sql(5, 11, -1, 1))
def q38_crop_or_pad_mixed(spark, sf):
    return _long(_images(spark, sf), I.crop_or_pad(F.col("img"), (5, 11)))


@query(f"WITH {_PIX} SELECT vec_id, round(sum(CASE WHEN sqrt(((i // 8) - 4.0) * ((i // 8) - 4.0) + ((i % 8) - 4.0) * ((i % 8) - 4.0)) < 3 THEN x ELSE 0 END), 4) AS total FROM px GROUP BY vec_id")
def q39_mask_apply(spark, sf):
    shown = I.apply_mask(F.col("img"), I.circle_mask(S, 3))
    return _images(spark, sf).select("vec_id", F.round(F.aggregate(shown["data"], F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


@query(f"WITH {_PIX} SELECT vec_id, i, CAST(floor(greatest(0.0, least(255.0, (x * 200.0 + 100.0) * (255.0::DOUBLE / 200.0::DOUBLE)))) AS INTEGER) AS v FROM px")
def q40_hmi(spark, sf):
    return _long(_images(spark, sf, 200.0), hmi_intscale(F.col("img")), "int")


def _aia_sql() -> str:
    shape = {"sqrt": "sqrt({})", "log10": "log10({})", "linear": "{}"}
    parts = []
    for k, (w, (low, high, ref, form)) in enumerate(BANDS.items()):
        x = f"(x * ({ref!r}::DOUBLE / 2.0::DOUBLE))" if ref else "(x / 2.0::DOUBLE)"
        a, b = (shape[form].format(f"{v!r}::DOUBLE") for v in (low, high))
        y = shape[form].format(f"greatest({low!r}::DOUBLE, least({high!r}::DOUBLE, {x}))")
        parts.append(f"WHEN {k} THEN ({y} - {a}) / ({b} - {a}) * 255.0::DOUBLE")
    return f"WITH {_PIX.replace('CAST(unnest(embedding) AS DOUBLE) AS x', 'CAST(unnest(embedding) AS DOUBLE) * 5000.0::DOUBLE AS x')} SELECT vec_id, i, CAST(floor(greatest(0.0, least(255.0, CASE vec_id % 11 {' '.join(parts)} END))) AS INTEGER) AS v FROM px"


@query(_aia_sql())
def q41_aia(spark, sf):
    band = F.element_at(F.array(*[F.lit(float(w)) for w in BANDS]), (F.col("vec_id") % 11 + 1).cast("int"))
    return _long(_images(spark, sf, 5000.0), aia_intscale(F.col("img"), 2.0, band), "int")


def _sample_sql(h: int, w: int, sy: str, sx: str, order: int, cval: float = 0.0) -> str:
    """Bilinear or nearest sampling at the places sy, sx, written over j // w and j % w."""
    at = f"WITH e AS (SELECT vec_id, embedding AS d FROM embeddings), g AS (SELECT CAST(unnest(range({h * w})) AS INTEGER) AS j), s AS (SELECT vec_id, d, j, {sy} AS sy, {sx} AS sx FROM e CROSS JOIN g), f AS (SELECT *, CAST(floor(sy) AS INTEGER) AS y0, CAST(floor(sx) AS INTEGER) AS x0 FROM s)"
    if order == 0:
        value = "CAST(d[CAST(floor(sy + 0.5) * 8 + floor(sx + 0.5) AS INTEGER) + 1] AS DOUBLE)"
    else:
        p = lambda y, x: f"CAST(d[{y} * 8 + {x} + 1] AS DOUBLE)"
        y1, x1 = "least(y0 + 1, 7)", "least(x0 + 1, 7)"
        value = f"{p('y0', 'x0')} * (1 - (sy - y0)) * (1 - (sx - x0)) + {p('y0', x1)} * (1 - (sy - y0)) * (sx - x0) + {p(y1, 'x0')} * (sy - y0) * (1 - (sx - x0)) + {p(y1, x1)} * (sy - y0) * (sx - x0)"
    return f"{at} SELECT vec_id, j AS i, round(CASE WHEN sy >= 0 AND sy <= 7 AND sx >= 0 AND sx <= 7 THEN {value} ELSE {cval}::DOUBLE END, 6) AS v FROM f"


def _zoom_sql(h: int, w: int, order: int) -> str:
    return _sample_sql(h, w, f"least((j // {w}) * (7.0::DOUBLE / {h - 1}), 7.0)", f"least((j % {w}) * (7.0::DOUBLE / {w - 1}), 7.0)", order)


@query(_zoom_sql(5, 11, 0))
def q42_resize_nearest(spark, sf):
    return _long(_images(spark, sf), I.resize_image(F.col("img"), (5, 11), order=0), digits=6)


@query(_zoom_sql(5, 11, 1))
def q43_resize_bilinear(spark, sf):
    return _long(_images(spark, sf), I.resize_image(F.col("img"), (5, 11)), digits=6)


def _turn_sql(angle: float, order: int, cval: float) -> str:
    (c, s), (oy, ox), h, w = I.rotation(angle, S, S, False)
    y, x = f"(j // {w})", f"(j % {w})"
    return _sample_sql(h, w, f"{y} * ({c!r}::DOUBLE) + {x} * ({s!r}::DOUBLE) + ({oy!r}::DOUBLE)", f"{y} * ({-s!r}::DOUBLE) + {x} * ({c!r}::DOUBLE) + ({ox!r}::DOUBLE)", order, cval)


@query(_turn_sql(90, 0, 0))
def q44_rotate_90(spark, sf):
    return _long(_images(spark, sf), I.rotate_image(F.col("img"), 90, (S, S), order=0), digits=6)


@query(_turn_sql(30, 1, -1.0))
def q45_rotate_30_bilinear(spark, sf):
    return _long(_images(spark, sf), I.rotate_image(F.col("img"), 30, (S, S), order=1, cval=-1.0), digits=6)


# Links

_HREF = r"""<a\s[^>]*?href="([^"]*)\""""
_LINKS_SQL = f"l AS (SELECT page_id, CAST(unnest(range(len(h))) AS INTEGER) AS pos, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?i){_HREF}', 1) AS h FROM pages))"


@query(f"WITH {_LINKS_SQL} SELECT page_id, pos, href FROM l")
def q46_links_all(spark, sf):
    return L.links(read(spark, sf, "pages"))


@query(f"WITH {_LINKS_SQL} SELECT ends_with(lower(href), '.html') OR ends_with(lower(href), '.') AS has_ext, starts_with(href, '/') AS rooted, contains(href, '?') AS has_query, contains(lower(href), 'parent') OR contains(lower(href), '..') OR contains(lower(href), 'index') OR contains(lower(href), 'readme') AS skipped, count(*) AS n FROM l GROUP BY ALL")
def q47_links_classified(spark, sf):
    return L.classified(L.links(read(spark, sf, "pages")), ["html", ""]).groupBy("has_ext", "rooted", "has_query", "skipped").agg(F.count("*").alias("n"))


@query("SELECT page_id, regexp_extract(split_part(url, '?', 1), '([^/]*)$', 1) AS file FROM pages")
def q48_url_files(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.regexp_extract(F.substring_index("url", "?", 1), "([^/]*)$", 1).alias("file"))


# Ranges


@query("WITH p AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT vec_id, min(x) AS low, max(x) AS high FROM p WHERE x >= 0 GROUP BY vec_id")
def q49_nan_range(spark, sf):
    """Negative values become NaN, which the range leaves out."""
    data = F.transform("embedding", lambda v: F.when(v < 0, float("nan")).otherwise(v.cast("double")))
    low, high = I.value_range(F.col("img"))
    return read(spark, sf, "embeddings").select("vec_id", I.image(data, S, S).alias("img")).select("vec_id", low.alias("low"), high.alias("high")).where("low IS NOT NULL")


@query("WITH p AS (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) SELECT round(quantile_cont(x, 0.01), 6) AS p01, round(quantile_cont(x, 0.99), 6) AS p99 FROM p")
def q50_percentile_stretch(spark, sf):
    q = read(spark, sf, "embeddings").select(F.explode("embedding").alias("x")).select(F.col("x").cast("double").alias("x")).agg(F.percentile("x", F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    return q.select(F.round(F.col("q")[0], 6).alias("p01"), F.round(F.col("q")[1], 6).alias("p99"))


def _spline_rows(at: list[float], order: int) -> list[list[float]]:
    """What each of 8 values in a row counts at a place: basis functions there, times the inverse of those at the values,
    both mirrored about the ends."""

    def basis(d: float) -> float:
        d = abs(d)
        if order == 3:
            return 2 / 3 - d * d + d**3 / 2 if d < 1 else max(0.0, 2 - d) ** 3 / 6
        return 0.75 - d * d if d <= 0.5 else max(0.0, 1.5 - d) ** 2 / 2

    def around(x: float) -> list[float]:
        out = [0.0] * S
        for k in range(-4, S + 4):
            m = abs(k) % (2 * S - 2)
            out[m if m < S else 2 * S - 2 - m] += basis(x - k)
        return out

    inverse = np.linalg.inv(np.array([around(float(i)) for i in range(S)]))
    return (np.array([around(x) for x in at]) @ inverse).tolist()


def _spline_sql(places: list[tuple[float, float]], order: int, cval: float = 0.0) -> str:
    """Spline samples at places (y, x) as sums over the 64 values of an image."""
    inside = [0 <= y <= S - 1 and 0 <= x <= S - 1 for y, x in places]
    ys, xs = (_spline_rows([p[k] if ok else 0.0 for p, ok in zip(places, inside)], order) for k in (0, 1))
    values = ", ".join(f"({j}, {str(ok).upper()}, [{', '.join(map(repr, ys[j]))}], [{', '.join(map(repr, xs[j]))}])" for j, ok in enumerate(inside))
    return f"WITH {_PIX}, p(j, inside, wy, wx) AS (VALUES {values}) SELECT vec_id, CAST(j AS INTEGER) AS i, round(CASE WHEN any_value(inside) THEN sum(x * wy[i // 8 + 1]::DOUBLE * wx[i % 8 + 1]::DOUBLE) ELSE {cval}::DOUBLE END, 6) + 0.0::DOUBLE AS v FROM px CROSS JOIN p GROUP BY vec_id, j"


@query(_spline_sql([(y * 7 / 11, x * 7 / 11) for y in range(12) for x in range(12)], 3))
def q51_resize_bicubic(spark, sf):
    made = _images(spark, sf).withColumn("made", I.resize_image(F.col("img"), (12, 12), order=3))
    return _long(made, F.col("made"), digits=6).withColumn("v", F.col("v") + 0.0)  # no zero has a sign


def _turned_places(angle: float) -> list[tuple[float, float]]:
    (c, s), (oy, ox), h, w = I.rotation(angle, S, S, False)
    return [(y * c + x * s + oy, y * -s + x * c + ox) for y in range(h) for x in range(w)]


@query(_spline_sql(_turned_places(15), 2))
def q52_rotate_15_quadratic(spark, sf):
    made = _images(spark, sf).withColumn("made", I.rotate_image(F.col("img"), 15, (S, S), order=2))
    return _long(made, F.col("made"), digits=6).withColumn("v", F.col("v") + 0.0)


for module in (changes, texts):  # tables with changes, and statements as text
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
