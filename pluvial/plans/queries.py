"""Queries over the driver's tables, one for each operator, with the SQL that says the same.

``events`` stand in for observations (user = station, daily sum = rain),
``lineitem`` for grids and numbers, ``orders`` for a series of years. Computed
doubles are compared at four decimals.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pluvial.functions import expr
from pluvial.functions.columns import feature_group, first_of, month_name, numeric_columns, trimmed, without_suffix
from pluvial.operators import boosting, eda, features, frame, impute, joins, metrics, models, order_stats, selection, stats, store, validate
from pluvial.operators import windows as win
from pluvial.sources.files import with_origin

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Moves sums whose last digits hang on the order of rows away from the halves between two roundings.
NUDGE = 3e-9


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """All doubles at four decimals, but for ``keep``."""
    return df.withColumns({f.name: expr.round4(F.col(f.name) + NUDGE) for f in df.schema if f.dataType.simpleString() == "double" and f.name not in keep})


def r4(x: str) -> str:
    return f"(round_even((CAST({x} AS DOUBLE) + CAST({NUDGE} AS DOUBLE)) * 10000, 0) / 10000)"


# ---- the station-day stand-in


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``station, time, rain``: a row for each day that has events."""
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), F.to_date("ts").alias("time"), "value")
    return events.groupBy("station", "time").agg(expr.round4(F.sum("value") + NUDGE).alias("rain"))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame.dense(days(spark, sf_dir), "station", "time")


DAYS = f"d AS (SELECT user_id AS station, CAST(ts AS DATE) AS time, {r4('sum(value)')} AS rain FROM events GROUP BY 1, 2)"
FRAME = f"""{DAYS},
e AS (SELECT min(time) AS a, max(time) AS b FROM d),
c AS (SELECT CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS time FROM e),
s AS (SELECT DISTINCT station FROM d),
f AS (SELECT s.station, c.time, d.rain FROM s CROSS JOIN c LEFT JOIN d ON d.station = s.station AND d.time = c.time)"""
W = "OVER (PARTITION BY station ORDER BY time"


@query(f"WITH {FRAME} SELECT station, time, rain FROM f")
def station_day_frame(spark, sf_dir):
    return dense(spark, sf_dir)


@query(f"WITH {FRAME} SELECT station, time, rain, last_value(rain IGNORE NULLS) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS filled FROM f")
def ffill_limit2(spark, sf_dir):
    return dense(spark, sf_dir).withColumn("filled", win.carried("rain", win.by(["station"], "time"), 2))


@query(f"""WITH {FRAME} SELECT station, time, coalesce(last_value(rain IGNORE NULLS) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(rain IGNORE NULLS) {W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM f""")
def ffill_bfill(spark, sf_dir):
    return dense(spark, sf_dir).select("station", "time", win.carried_both("rain", win.by(["station"], "time")).alias("filled"))


@query(f"WITH {FRAME} SELECT station, time, lag(rain, 1) {W}) AS lag_1, lag(rain, 2) {W}) AS lag_2 FROM f")
def lag_features(spark, sf_dir):
    w = win.by(["station"], "time")
    return dense(spark, sf_dir).select("station", "time", win.lag("rain", w, 1).alias("lag_1"), win.lag("rain", w, 2).alias("lag_2"))


@query(f"WITH {FRAME} SELECT station, time, {r4(f'rain - lag(rain) {W})')} AS change FROM f")
def diff_feature(spark, sf_dir):
    return rounded(dense(spark, sf_dir).select("station", "time", win.diff("rain", win.by(["station"], "time")).alias("change")))


@query(f"WITH {FRAME} SELECT station, time, {r4(f'avg(rain) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS mean_3d, {r4(f'sum(rain) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS sum_3d FROM f")
def rolling_past_mean_sum(spark, sf_dir):
    w = win.by(["station"], "time")
    return rounded(dense(spark, sf_dir).select("station", "time", win.past_mean(F.col("rain"), w).alias("mean_3d"), win.past_sum(F.col("rain"), w).alias("sum_3d")))


@query(f"""WITH {FRAME}, m AS (SELECT station, time, rain, quantile_cont(rain, 0.5) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM f)
SELECT station, time, {r4('CASE WHEN rain IS NULL THEN q END')} AS past_median FROM m""")
def expanding_median_past(spark, sf_dir):
    found = win.with_past_median(dense(spark, sf_dir), "rain", ["station"], "time", "past_median")
    return rounded(found.select("station", "time", "past_median"))


PROXY = f"""{FRAME},
p AS (SELECT station, time, rain, CASE WHEN rain IS NULL THEN coalesce(
  last_value(rain IGNORE NULLS) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  quantile_cont(rain, 0.5) OVER (PARTITION BY station, isodow(time) ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
  quantile_cont(rain, 0.5) {W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) END AS proxy FROM f),
q AS (SELECT *, coalesce(rain, proxy) AS src FROM p)"""


def proxied(spark, sf_dir) -> DataFrame:
    return impute.past_proxy(dense(spark, sf_dir), "rain", "station", F.weekday("time"), "time", "proxy")


@query(f"""WITH {PROXY} SELECT station, time, rain, {r4('proxy')} AS proxy, {r4(f'lag(src, 1) {W})')} AS lag_1, {r4(f'lag(src, 2) {W})')} AS lag_2,
  {r4(f'avg(src) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS mean_3d, {r4(f'sum(src) {W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS sum_3d FROM q""")
def prcp_proxy(spark, sf_dir):
    w = win.by(["station"], "time")
    df = proxied(spark, sf_dir).withColumn("src", F.coalesce("rain", "proxy"))
    made = df.withColumns({"lag_1": win.lag("src", w, 1), "lag_2": win.lag("src", w, 2), "mean_3d": win.past_mean(F.col("src"), w), "sum_3d": win.past_sum(F.col("src"), w)})
    return rounded(made.drop("src"), "rain")


@query(f"""WITH {FRAME}, a AS (SELECT station, time, isodow(time) AS k, last_value(rain IGNORE NULLS) {W} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS x FROM f),
b AS (SELECT station, time, coalesce(x, median(x) OVER (PARTITION BY station, k)) AS x FROM a),
g AS (SELECT station, time, coalesce(x, median(x) OVER (PARTITION BY station)) AS x FROM b)
SELECT station, time, {r4('coalesce(x, (SELECT median(x) FROM g))')} AS filled FROM g""")
def visib_cascade(spark, sf_dir):
    filled = impute.cascade(dense(spark, sf_dir), "rain", "station", F.weekday("time"), "time")
    return rounded(filled.select("station", "time", F.col("rain").alias("filled")))


# ---- cleaning and units

LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def lines(spark, sf_dir, *columns) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *columns)


@query(f"SELECT {LINE}, CASE WHEN abs(l_discount - 0.1) <= 0.001 + 1e-5 * 0.1 THEN NULL ELSE l_discount END AS discount FROM lineitem")
def sentinel_clean(spark, sf_dir):
    return lines(spark, sf_dir, expr.missing_marked(F.col("l_discount"), 0.1).alias("discount"))


@query(f"SELECT {LINE}, CASE WHEN l_quantity BETWEEN 10 AND 40 THEN l_quantity END AS quantity FROM lineitem")
def range_clean(spark, sf_dir):
    return lines(spark, sf_dir, expr.within(F.col("l_quantity"), 10, 40).alias("quantity"))


@query(f"SELECT {LINE}, {r4('(l_quantity + (-32.0)) * (5.0::DOUBLE / 9.0::DOUBLE)')} AS celsius, {r4('l_quantity * 25.4')} AS mm, {r4('l_quantity * 0.514444')} AS ms, {r4('l_quantity * 1.60934')} AS km FROM lineitem")
def unit_convert(spark, sf_dir):
    q = F.col("l_quantity")
    return rounded(lines(spark, sf_dir, *[expr.metric(q, u).alias(n) for n, u in (("celsius", "fahrenheit"), ("mm", "inch"), ("ms", "knot"), ("km", "mile"))]))


@query(f"SELECT {LINE}, CAST(CAST(l_extendedprice AS FLOAT) - CAST(273.15 AS FLOAT) AS DOUBLE) AS celsius, CAST(CAST(l_extendedprice AS FLOAT) / CAST(9.80665 AS FLOAT) AS DOUBLE) AS metres FROM lineitem")
def float_units(spark, sf_dir):
    x = expr.as_float(F.col("l_extendedprice"))
    return lines(spark, sf_dir, expr.celsius(x).cast("double").alias("celsius"), expr.metres(x).cast("double").alias("metres"))


@query(f"SELECT {LINE}, CAST(CAST(l_extendedprice AS FLOAT) / CAST(100 AS FLOAT) AS DOUBLE) AS pressure, CAST(CAST(CAST(l_discount AS FLOAT) AS VARCHAR) AS DOUBLE) AS as_written, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS widened FROM lineitem")
def pressure_units(spark, sf_dir):
    """Pascal to hectopascal in single precision, and single values as their text reads beside their plain widening."""
    x = expr.as_float(F.col("l_discount"))
    pressure = expr.hectopascal(expr.as_float(F.col("l_extendedprice"))).cast("double")
    return lines(spark, sf_dir, pressure.alias("pressure"), expr.float_as_written(x).alias("as_written"), x.cast("double").alias("widened"))


@query("""SELECT o_orderkey, o_orderdate AS time, lower(trim(o_orderpriority)) AS priority, starts_with(o_orderpriority, '1') AS urgent, ends_with(o_orderpriority, 'W') AS low,
  contains(lower(o_orderpriority), 'spec') AS unspecified, format('{:,.2f}', o_totalprice) AS price FROM orders""")
def tidied_text(spark, sf_dir):
    """Column names trimmed, doubles of a join left out by suffix, the time column found by its aliases; then text tests and a written number."""
    o = table(spark, sf_dir, "orders")
    raw = o.select("o_orderkey", F.col("o_orderdate").alias(" Date "), F.col("o_orderpriority").alias("priority "), "o_totalprice", F.col("o_orderkey").alias("o_orderkey_y"))
    tidy = without_suffix(trimmed(raw), "_y")
    p = F.col("priority")
    return tidy.select("o_orderkey", F.col(first_of(tidy, ["time", "date"])).alias("time"), F.lower(F.trim(p)).alias("priority"), p.startswith("1").alias("urgent"), p.endswith("W").alias("low"), F.lower(p).contains("spec").alias("unspecified"), F.format_number("o_totalprice", 2).alias("price"))


@query("SELECT o_orderkey, 'station ' || CAST(o_custkey AS VARCHAR) AS station_name, CAST(year(o_orderdate) AS INTEGER) AS source_year, 'orders/' || CAST(year(o_orderdate) AS VARCHAR) AS source_url FROM orders")
def provenance(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    year = F.year("o_orderdate")
    return with_origin(o, F.concat(F.lit("station "), F.col("o_custkey").cast("string")), year, F.concat(F.lit("orders/"), year.cast("string"))).drop("o_custkey", "o_orderdate")


@query("SELECT event_id, round_even(value * 10000, 0) / 10000 AS value FROM events")
def round4(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", expr.round4(F.col("value")).alias("value"))


@query("SELECT s_suppkey, round_even(round_even(s_acctbal / 0.25, 0) * 0.25 * 100, 0) / 100 AS cell FROM supplier")
def grid_quantize(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", expr.quantized(F.col("s_acctbal")).alias("cell"))


@query("SELECT event_id, TRY_CAST(substr(event_type, 1, 1) || CAST(event_id AS VARCHAR) AS DOUBLE) AS bad, TRY_CAST(CAST(event_id AS VARCHAR) AS DOUBLE) AS good, TRY_CAST(event_type AS DATE) AS day FROM events")
def coerce(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.col("event_id").cast("string")
    return e.select("event_id", expr.numeric(F.concat(F.substring("event_type", 1, 1), text)).alias("bad"), expr.numeric(text).alias("good"), expr.day(F.col("event_type")).alias("day"))


@query(f"WITH x AS (SELECT *, CASE WHEN l_discount = 0 THEN CAST('inf' AS DOUBLE) WHEN l_tax = 0 THEN CAST('nan' AS DOUBLE) ELSE l_discount END AS v FROM lineitem) SELECT {LINE}, CASE WHEN isfinite(v) THEN v END AS v FROM x")
def inf_to_null(spark, sf_dir):
    v = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount"))
    return lines(spark, sf_dir, expr.finite(v).alias("v"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS status FROM orders")
def lookup_default(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", expr.mapped(F.col("o_orderstatus"), {"F": "finished", "O": "open"}).alias("status"))


# ---- keys, resampling, levels, joins


@query(f"""WITH d AS (SELECT user_id, CAST(ts AS DATE) AS time, avg(value) AS value, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS kind FROM events GROUP BY 1, 2),
s AS (SELECT user_id, min(time) AS a, max(time) AS b FROM d GROUP BY 1),
c AS (SELECT user_id, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(b AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS time FROM s)
SELECT c.user_id, c.time, {r4('d.value')} AS value FROM c LEFT JOIN d ON d.user_id = c.user_id AND d.time = c.time""")
def daily_resample(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("time"), "value")
    return rounded(frame.daily(events, ["user_id"], "time", ["value"]))


@query("SELECT l_suppkey, min(quantity) AS quantity FROM (SELECT l_suppkey, first_value(q) OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, q) AS quantity FROM (SELECT l_suppkey, l_shipdate, CASE WHEN l_quantity >= 10 THEN l_quantity END AS q FROM lineitem) WHERE q IS NOT NULL) GROUP BY l_suppkey")
def first_valid(spark, sf_dir):
    known = lines(spark, sf_dir, "l_shipdate", F.when(F.col("l_quantity") >= 10, F.col("l_quantity")).alias("q")).withColumn("place", F.struct("l_shipdate", "q"))
    return known.groupBy("l_suppkey").agg(frame.first_valid("q", "place").alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS k FROM lineitem) WHERE k = 1")
def dedup_first(spark, sf_dir):
    found = frame.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"])
    return found.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query("""WITH g AS (SELECT l_suppkey, l_returnflag AS lv, max(l_quantity) AS q, max(l_discount) AS t FROM lineitem GROUP BY 1, 2)
SELECT a.l_suppkey, a.q AS q_A, a.t AS t_A, b.q AS q_R, b.t AS t_R FROM g a JOIN g b ON a.l_suppkey = b.l_suppkey WHERE a.lv = 'A' AND b.lv = 'R'""")
def level_pivot_inner(spark, sf_dir):
    g = lines(spark, sf_dir, "l_returnflag", "l_quantity", "l_discount").groupBy("l_suppkey", "l_returnflag").agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("t"))
    return frame.levels_wide(g, ["l_suppkey"], "l_returnflag", ["A", "R"], ["q", "t"])


CELL = "round_even(round_even({x} / 250.0, 0) * 250.0 * 100, 0) / 100"


@query(f"""WITH g AS (SELECT CAST(o_orderdate AS DATE) AS time, {CELL.format(x='o_totalprice')} AS latitude, max(o_totalprice) AS v FROM orders GROUP BY 1, 2),
p AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS time, {CELL.format(x='(o_totalprice + 100)')} AS latitude FROM orders)
SELECT p.o_orderkey, p.time, p.latitude, g.v FROM p LEFT JOIN g ON g.time = p.time AND g.latitude = p.latitude""")
def grid_join_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("time", F.to_date("o_orderdate"))
    cell = lambda c: expr.quantized(c, 250.0)
    grid = orders.groupBy("time", cell(F.col("o_totalprice")).alias("latitude")).agg(F.max("o_totalprice").alias("v")).withColumn("longitude", F.lit(0.0))
    points = orders.select("o_orderkey", "time", cell(F.col("o_totalprice") + 100).alias("cell_lat"), F.lit(0.0).alias("cell_lon"))
    return joins.with_grid(points, grid).select("o_orderkey", "time", F.col("cell_lat").alias("latitude"), "v")


@query("SELECT o.o_orderkey, c.c_name, n.n_name FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_custkey LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey")
def meta_join_left(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    people = joins.with_metadata(orders, table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("n_nationkey")), ["c_custkey"])
    return joins.with_metadata(people, table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), ["n_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_join(spark, sf_dir):
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return joins.matching(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), done, ["c_custkey"])


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_join(spark, sf_dir):
    back = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.unmatched(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), back, ["o_orderkey"])


@query("""WITH a AS (SELECT p_brand, max(p_retailprice) AS top FROM part WHERE p_size < 10 GROUP BY 1), b AS (SELECT p_brand, min(p_retailprice) AS low FROM part WHERE p_size > 45 GROUP BY 1)
SELECT coalesce(a.p_brand, b.p_brand) AS p_brand, coalesce(top, 0.0) AS top, coalesce(low, 0.0) AS low FROM a FULL JOIN b ON a.p_brand = b.p_brand""")
def outer_scores(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    a = part.where("p_size < 10").groupBy("p_brand").agg(F.max("p_retailprice").alias("top"))
    return joins.outer_filled(a, part.where("p_size > 45").groupBy("p_brand").agg(F.min("p_retailprice").alias("low")), "p_brand")


@query("SELECT c_custkey AS key, 'customer' AS kind, c_acctbal AS balance, NULL::VARCHAR AS note FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, s_name FROM supplier")
def union_all(spark, sf_dir):
    from pluvial.sources.files import stacked

    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"), F.col("s_name").alias("note"))
    return stacked([a, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"))])


@query("SELECT c_nationkey AS k, 'both' AS side FROM customer INTERSECT SELECT s_nationkey, 'both' FROM supplier UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)")
def set_operations(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    return c.intersect(s).withColumn("side", F.lit("both")).unionByName(c.subtract(s).withColumn("side", F.lit("customer")))


# ---- derived features

TURN = "2 * pi()"


@query(f"SELECT DISTINCT CAST(o_orderdate AS DATE) AS time, {r4(f'sin({TURN} * dayofyear(o_orderdate) / 365)')} AS day_sin, {r4(f'cos({TURN} * dayofyear(o_orderdate) / 365)')} AS day_cos, {r4(f'sin({TURN} * month(o_orderdate) / 12)')} AS month_sin, {r4(f'cos({TURN} * month(o_orderdate) / 12)')} AS month_cos FROM orders")
def cyclical_time(spark, sf_dir):
    return rounded(features.seasonal(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("time")).distinct()))


@query(f"SELECT {LINE}, {r4('sqrt(l_discount * l_discount + l_tax * l_tax)')} AS magnitude FROM lineitem")
def vector_norm(spark, sf_dir):
    return rounded(lines(spark, sf_dir, expr.norm(F.col("l_discount"), F.col("l_tax")).alias("magnitude")))


@query(f"SELECT {LINE}, {r4('l_discount / nullif(l_tax, 0)')} AS ratio FROM lineitem")
def safe_ratio(spark, sf_dir):
    return rounded(lines(spark, sf_dir, expr.ratio(F.col("l_discount"), F.col("l_tax")).alias("ratio")))


@query(f"""WITH x AS (SELECT *, l_quantity AS q, l_discount * 10 AS w, l_tax AS u FROM lineitem)
SELECT {LINE}, {r4('q * w')} AS moist_convection_850, {r4('q * sqrt(u * u + w * w)')} AS moisture_flux_850, {r4('(q - w) / nullif(u - w / 10, 0)')} AS lapse_rate_850_500, {r4('u - w / 10')} AS thickness_500_850 FROM x""")
def physical_features(spark, sf_dir):
    q, w, u = F.col("l_quantity"), F.col("l_discount") * 10, F.col("l_tax")
    named = lines(spark, sf_dir, q.alias("q_850"), w.alias("w_850"), u.alias("u_850"), w.alias("v_850"), q.alias("t_850"), w.alias("t_500"), u.alias("z_500"), (w / 10).alias("z_850"))
    keep = ["moist_convection_850", "moisture_flux_850", "lapse_rate_850_500", "thickness_500_850"]
    return rounded(features.physical(named).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *keep))


@query(f"WITH {FRAME} SELECT station, time, rain AS target_1stage_prcp_mm, CAST(rain >= 0.1 AS INTEGER) AS target_stage1_rain_label, {r4('ln(1 + rain)')} AS target_stage2_prcp_log1p FROM f")
def targets(spark, sf_dir):
    return rounded(features.targets(dense(spark, sf_dir), "rain").drop("rain"), "target_1stage_prcp_mm")


@query(f"WITH {FRAME} SELECT station, time, rain AS target_1stage_prcp_mm, CAST(rain >= 0.1 AS INTEGER) AS target_stage1_rain_label, {r4('ln(1 + rain)')} AS target_stage2_prcp_log1p FROM f WHERE rain IS NOT NULL")
def complete_targets(spark, sf_dir):
    """Only days on which every target is known."""
    named = features.targets(dense(spark, sf_dir), "rain").drop("rain")
    return rounded(named.na.drop(subset=[c for c in named.columns if c.startswith("target_")]), "target_1stage_prcp_mm")


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS year, CAST(month(ts) AS INTEGER) AS month, CAST(dayofyear(ts) AS INTEGER) AS day_of_year, CASE WHEN value >= 50 THEN 'rain' ELSE 'dry' END AS status FROM events")
def date_parts(spark, sf_dir):
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.year("ts").alias("year"), F.month("ts").alias("month"), F.dayofyear("ts").alias("day_of_year"), expr.labelled([(v >= 50, "rain")], "dry").alias("status"))


# ---- splits and expectations

SPLIT = "CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1998 THEN 'train' WHEN year(o_orderdate) = 1999 THEN 'valid' WHEN year(o_orderdate) = 2000 THEN 'test' ELSE 'outside' END"


def summary_sql(key: str, x: str, time: str, source: str) -> str:
    q = lambda p: r4(f"quantile_cont({x}, {p})")
    return f"""SELECT {key}, count(*) AS rows, count({x}) AS known, {r4(f'coalesce(sum({x}), 0)')} AS sum, {r4(f'avg({x})')} AS mean, {q(0.5)} AS median, {q(0.95)} AS p95, {q(0.99)} AS p99, max({x}) AS max,
  {r4(f'CAST(count(*) FILTER ({x} >= 0.1) AS DOUBLE) * 100 / nullif(count({x}), 0)')} AS rainy_percent, min({time}) AS first, max({time}) AS last FROM {source} GROUP BY 1"""


@query(summary_sql(f"{SPLIT} AS split", "o_totalprice", "o_orderdate", "orders"))
def time_split_summary(spark, sf_dir):
    label = validate.split_label("o_orderdate", (1995, 1998), 1999, 2000)
    return rounded(eda.summary(table(spark, sf_dir, "orders"), [label.alias("split")], "o_totalprice", "o_orderdate"), "max")


@query("SELECT 'train' AS part, count(*) AS rows FROM orders WHERE o_orderdate < '1999-01-01' UNION ALL SELECT 'valid', count(*) FROM orders WHERE o_orderdate >= '1999-01-01' AND o_orderdate < '2000-01-01' UNION ALL SELECT 'test', count(*) FROM orders WHERE o_orderdate >= '2000-01-01'")
def time_split(spark, sf_dir):
    parts = validate.split_by_time(table(spark, sf_dir, "orders"), "o_orderdate", "1999-01-01", "2000-01-01")
    a, b, c = (p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("rows")) for n, p in zip(("train", "valid", "test"), parts, strict=True))
    return a.unionByName(b).unionByName(c)


@query(f"""WITH {FRAME}, v AS (SELECT count(*) FILTER (rain IS NULL) AS known, count(*) FILTER (NOT coalesce(rain >= 0, false)) AS not_negative, count(*) FILTER (NOT coalesce(rain <= 100, false)) AS bounded FROM f)
SELECT 'known' AS rule, known AS violations FROM v UNION ALL SELECT 'not_negative', not_negative FROM v UNION ALL SELECT 'bounded', bounded FROM v""")
def expectation_counts(spark, sf_dir):
    r = F.col("rain")
    return validate.violations(dense(spark, sf_dir), {"known": r.isNotNull(), "not_negative": r >= 0, "bounded": r <= 100})


@query(f"SELECT 'height_inverted' AS name, {r4('avg(CAST(l_discount <= l_tax AS INTEGER))')} AS share FROM lineitem UNION ALL SELECT 'temperature_inverted', {r4('avg(CAST(l_quantity <= l_linenumber AS INTEGER))')} FROM lineitem")
def level_sanity(spark, sf_dir):
    named = lines(spark, sf_dir, F.col("l_discount").alias("z_500"), F.col("l_tax").alias("z_850"), F.col("l_quantity").alias("t_850"), F.col("l_linenumber").alias("t_500"))
    return rounded(validate.pressure_level_faults(named))


@query("SELECT 'absent' AS side, l AS level FROM (VALUES ('A'), ('N'), ('R'), ('X')) AS t(l) WHERE l NOT IN (SELECT l_returnflag FROM lineitem)")
def missing_levels(spark, sf_dir):
    gone = validate.absent_levels(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R", "X"])
    return spark.createDataFrame([("absent", g) for g in gone], "side string, level string")


# ---- summaries


@query("SELECT user_id, arg_min(event_type, struct_pack(a := ts, b := event_type)) AS station_name, count(*) AS n_rows, count(DISTINCT year(ts)) AS n_years, min(ts) AS start_date, max(ts) AS end_date, count(DISTINCT CAST(ts AS DATE)) AS n_unique_days FROM events GROUP BY 1")
def station_summary(spark, sf_dir):
    return eda.station_summary(table(spark, sf_dir, "events"), "user_id", "event_type", "ts")


def missing_sql(key: str) -> str:
    return f"""WITH {FRAME} SELECT {key}, count(*) AS rows, count(rain) AS known, count(*) - count(rain) AS missing, {r4('(count(*) - count(rain)) * 100.0::DOUBLE / count(*)')} AS missing_percent,
  {r4('avg(rain)')} AS mean, {r4('median(rain)')} AS median, max(rain) AS max, count(*) FILTER (rain >= 60) AS rainy, {r4('CAST(count(*) FILTER (rain >= 60) AS DOUBLE) * 100 / nullif(count(rain), 0)')} AS rainy_percent FROM f GROUP BY ALL"""


@query(missing_sql("station"))
def missing_by_station(spark, sf_dir):
    return rounded(eda.missing_by(dense(spark, sf_dir), ["station"], "rain", 60), "max")


@query(missing_sql("CAST(year(time) AS INTEGER) AS year, CAST(month(time) AS INTEGER) AS month"))
def missing_by_year_month(spark, sf_dir):
    return rounded(eda.missing_by(dense(spark, sf_dir), [F.year("time").alias("year"), F.month("time").alias("month")], "rain", 60), "max")


@query(f"SELECT CAST(month(o_orderdate) AS INTEGER) AS month, {r4('avg(CAST(o_totalprice >= 200000 AS INTEGER))')} AS rain_probability, {r4('sum(o_totalprice)')} AS sum, count(o_totalprice) AS count, {r4('avg(o_totalprice)')} AS mean, {r4('median(o_totalprice)')} AS median, {r4('quantile_cont(o_totalprice, 0.95)')} AS p95, max(o_totalprice) AS max FROM orders GROUP BY 1")
def monthly_seasonality(spark, sf_dir):
    return rounded(eda.seasonality(table(spark, sf_dir, "orders"), F.month("o_orderdate"), "month", "o_totalprice", 200000), "max")


@query(summary_sql("CAST(year(o_orderdate) AS INTEGER) AS year", "o_totalprice", "o_orderdate", "orders"))
def yearly_summary(spark, sf_dir):
    return rounded(eda.summary(table(spark, sf_dir, "orders"), [F.year("o_orderdate").alias("year")], "o_totalprice", "o_orderdate"), "max")


@query(summary_sql("user_id", "value", "ts", "events"))
def station_quantiles(spark, sf_dir):
    return rounded(eda.summary(table(spark, sf_dir, "events"), [F.col("user_id")], "value", "ts"), "max")


P10 = [0.0, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99, 1.0]


@query(" UNION ALL ".join(f"SELECT '{n}' AS subset, CAST({p} AS DOUBLE) AS probability, {r4(f'quantile_cont(value, {p})')} AS value FROM events{w}" for n, w in (("all", ""), ("high", " WHERE value >= 50")) for p in P10))
def quantile_table(spark, sf_dir):
    found = eda.quantiles(table(spark, sf_dir, "events"), "value", P10, {"all": F.lit(True), "high": F.col("value") >= 50})
    return rounded(found, "probability")


OVERVIEW = {
    "rows": "count(*)", "stations": "count(DISTINCT station)", "days": "count(DISTINCT time)", "years": "count(DISTINCT year(time))", "known": "count(rain)", "missing": "count(*) - count(rain)",
    "missing_percent": "(count(*) - count(rain)) * 100.0::DOUBLE / count(*)", "zero": "count(*) FILTER (rain = 0)", "rainy": "count(*) FILTER (rain >= 60)", "dry": "count(*) FILTER (rain < 60)",
    "rainy_percent": "CAST(count(*) FILTER (rain >= 60) AS DOUBLE) * 100 / count(rain)", "sum": "coalesce(sum(rain), 0)", "mean": "avg(rain)", "median": "median(rain)", "p95": "quantile_cont(rain, 0.95)", "p99": "quantile_cont(rain, 0.99)",
    "min": "min(rain)", "max": "max(rain)", "rainy_mean": "avg(rain) FILTER (rain >= 60)", "rainy_median": "median(rain) FILTER (rain >= 60)", "rainy_max": "max(rain) FILTER (rain >= 60)",
}


@query(f"WITH {FRAME} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, {r4(v)} AS value FROM f" for k, v in OVERVIEW.items()))
def overview_long(spark, sf_dir):
    return rounded(eda.overview(dense(spark, sf_dir), "station", "time", "rain", 60))


@query(f"WITH {PROXY} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count(*) - count({c}) AS missing, {r4(f'(count(*) - count({c})) * 100.0::DOUBLE / count(*)')} AS percent FROM p" for c in ("station", "time", "rain", "proxy")))
def column_missingness(spark, sf_dir):
    return rounded(eda.missing_per_column(proxied(spark, sf_dir), ["station", "time", "rain", "proxy"]))


@query(f"""WITH {PROXY}, m AS (""" + " UNION ALL ".join(f"SELECT '{g}' AS g, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS p FROM p" for c, g in (("station", "key"), ("time", "key"), ("rain", "value"), ("proxy", "value"))) + f""")
SELECT g AS "group", count(*) AS columns, {r4('avg(p)')} AS average, {r4('max(p)')} AS largest, {r4('min(p)')} AS smallest FROM m GROUP BY 1""")
def group_missingness(spark, sf_dir):
    groups = {"station": "key", "time": "key", "rain": "value", "proxy": "value"}
    return rounded(eda.group_missingness(eda.missing_per_column(proxied(spark, sf_dir), list(groups)), groups))


@query(f"WITH {FRAME} SELECT count(*) AS rows, CAST(3 AS INTEGER) AS columns, count(DISTINCT station) AS stations, min(time) AS first, max(time) AS last, count(rain) AS with_target FROM f")
def dataset_summary(spark, sf_dir):
    return eda.dataset(dense(spark, sf_dir), "station", "time", "rain")


@query("WITH k AS (SELECT * FROM (VALUES (0, 'O'), (1, 'F'), (2, 'P'), (3, 'Z')) AS t(place, category)), n AS (SELECT o_orderstatus, count(*) AS c FROM orders GROUP BY 1) SELECT CAST(place AS INTEGER) AS place, category, coalesce(c, 0) AS count FROM k LEFT JOIN n ON n.o_orderstatus = k.category")
def value_counts_fixed(spark, sf_dir):
    return eda.value_counts(table(spark, sf_dir, "orders"), F.col("o_orderstatus"), ["O", "F", "P", "Z"])


MONTHS = range(1, 13)


@query("SELECT o_orderpriority, " + ", ".join(r4(f"avg(CASE WHEN month(o_orderdate) = {m} THEN CAST(o_totalprice >= 200000 AS INTEGER) END)") + f' AS "{m}"' for m in MONTHS) + " FROM orders GROUP BY 1")
def pivot_station_month(spark, sf_dir):
    return rounded(eda.pivoted(table(spark, sf_dir, "orders"), "o_orderpriority", F.month("o_orderdate"), list(MONTHS), F.avg((F.col("o_totalprice") >= 200000).cast("double"))))


@query(f"""WITH b AS (SELECT min(value) AS a, max(value) AS z FROM events), w AS (SELECT a, z, (z - a) / 60 AS w FROM b),
h AS (SELECT CAST(least(floor((value - a) / w) + 1, 60) AS INTEGER) AS bin, count(*) AS n FROM events, w GROUP BY 1)
SELECT CAST(k AS INTEGER) AS bin, {r4('a + (k - 1) * w')} AS low, {r4('a + k * w')} AS high, coalesce(n, 0) AS count FROM (SELECT unnest(range(1, 61)) AS k) CROSS JOIN w LEFT JOIN h ON h.bin = k""")
def histogram(spark, sf_dir):
    return rounded(eda.histogram(table(spark, sf_dir, "events"), "value", 60))


@query(f"""WITH q AS (SELECT event_type AS key, quantile_cont(value, 0.25) AS q1, median(value) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1),
e AS (SELECT key, min(value) AS low, max(value) AS high FROM events JOIN q ON event_type = key WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY 1)
SELECT q.key, {r4('q1')} AS q1, {r4('median')} AS median, {r4('q3')} AS q3, low, high FROM q JOIN e ON e.key = q.key""")
def box_stats(spark, sf_dir):
    return rounded(eda.boxes(table(spark, sf_dir, "events"), "event_type", "value"), "low", "high")


@query(f"SELECT event_id, {r4('least(value, (SELECT quantile_cont(value, 0.99) FROM events))')} AS value FROM events")
def clip_p99(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", "value")
    (bound,) = order_stats.percentiles(events, {"p99": (F.col("value"), [0.99])})["p99"]
    return rounded(events.select("event_id", expr.clipped(F.col("value"), high=F.lit(bound).cast("double")).alias("value")))


POINTS = [float(p) for p in range(0, 101, 10)]


@query(" UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS point, {r4(f'avg(exp(-0.5 * ((value - {p}) / 5.0) * ((value - {p}) / 5.0)) / (5.0 * sqrt(2 * pi())))')} AS density FROM events" for p in POINTS))
def kernel_density(spark, sf_dir):
    return rounded(eda.density(table(spark, sf_dir, "events"), "value", POINTS, 5.0), "point")


# ---- correlation and ranking measures

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = [(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r4(f'corr({a}, {b})')} AS r FROM lineitem" for a, b in PAIRS))
def pearson_pairs(spark, sf_dir):
    return rounded(stats.pearson_pairs(table(spark, sf_dir, "lineitem").select(*NUMBERS), NUMBERS))


RANKS = "WITH n AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem), k AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in NUMBERS) + " FROM n)"


@query(RANKS + " " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, {r4(f'corr({a}, {b})')} AS r FROM k" for a, b in PAIRS))
def spearman_pairs(spark, sf_dir):
    return rounded(stats.spearman_pairs(table(spark, sf_dir, "lineitem"), NUMBERS))


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM lineitem" for a, b in PAIRS) + f"), e AS (SELECT a AS c, abs(r) AS r FROM p UNION ALL SELECT b, abs(r) FROM p) SELECT c AS column, {r4('avg(r)')} AS strength FROM e GROUP BY 1 ORDER BY avg(r) DESC, c LIMIT 3")
def topk_corr(spark, sf_dir):
    return rounded(stats.strongest(stats.pearson_pairs(table(spark, sf_dir, "lineitem").select(*NUMBERS), NUMBERS), 3))


JUDGED = "j AS (SELECT l.quality AS y, d.n_chars AS s FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL AND d.n_chars IS NOT NULL), g AS (SELECT s, sum(y) AS p, sum(1 - y) AS n FROM j GROUP BY 1)"


def judged(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", "quality").join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")


@query(f"WITH {JUDGED}, c AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM g) SELECT {r4('sum(p * (u + n / 2.0::DOUBLE)) / (sum(p) * sum(n))')} AS roc_auc FROM c")
def roc_auc(spark, sf_dir):
    return rounded(stats.roc_auc(judged(spark, sf_dir), "quality", "n_chars"))


@query(f"WITH {JUDGED}, c AS (SELECT p, sum(p) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(p + n) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS al FROM g) SELECT {r4('sum(CAST(p AS DOUBLE) * tp / al) / sum(p)')} AS average_precision FROM c")
def avg_precision(spark, sf_dir):
    return rounded(stats.average_precision(judged(spark, sf_dir), "quality", "n_chars"))


# ---- metrics, selection, models


def metric_sql(y: str, p: str, source: str, key: str = "") -> str:
    k = f"{key}, " if key else ""
    return f"""SELECT {k}count(*) AS n, {r4(f'avg(abs({p} - {y}))')} AS mae, {r4(f'sqrt(avg(({p} - {y}) * ({p} - {y})))')} AS rmse, {r4(f'CASE WHEN sum(abs({y})) > 0 THEN 100 * sum(abs({p} - {y})) / sum(abs({y})) END')} AS wape_percent,
  {r4(f'1 - sum(({p} - {y}) * ({p} - {y})) / nullif(var_pop({y}) * count({y}), 0)')} AS r2, {r4(f'avg({p} - {y})')} AS bias FROM {source}{' GROUP BY ' + key if key else ''}"""


LAGGED = f"{FRAME}, l AS (SELECT station, time, rain, greatest(lag(rain) {W}), 0.0) AS p FROM f), m AS (SELECT * FROM l WHERE rain IS NOT NULL AND p IS NOT NULL)"


def lagged(spark, sf_dir) -> DataFrame:
    return dense(spark, sf_dir).withColumn("lag_1", win.lag("rain", win.by(["station"], "time")))


@query(f"WITH {FRAME}, x AS (SELECT station, time, rain, lag(rain) {W}) AS g FROM f), m AS (SELECT rain, greatest(g, 0.0) AS p FROM x WHERE rain IS NOT NULL AND g IS NOT NULL) {metric_sql('rain', 'p', 'm')}")
def metrics_persistence(spark, sf_dir):
    return rounded(metrics.regression(metrics.persistence(lagged(spark, sf_dir), "lag_1"), "rain", "prediction"))


@query(f"WITH {FRAME}, x AS (SELECT rain, greatest(coalesce(lag(rain) {W}), 0.0), 0.0) AS p FROM f), m AS (SELECT * FROM x WHERE rain IS NOT NULL) {metric_sql('rain', 'p', 'm')}")
def metrics_dashboard(spark, sf_dir):
    return rounded(metrics.regression_clipped(metrics.persistence(lagged(spark, sf_dir), "lag_1", fill=True), "rain", "prediction"))


@query(f"""WITH r AS (SELECT p_brand AS scenario, CASE WHEN p_size <= 25 THEN 'full' ELSE 'selected' END AS fs, avg(p_retailprice) AS mae, count(*) AS n FROM part GROUP BY 1, 2)
SELECT a.scenario, {r4('a.mae')} AS mae_full, {r4('b.mae')} AS mae_selected, a.n AS n_full, b.n AS n_selected FROM r a JOIN r b ON a.scenario = b.scenario AND a.fs = 'full' AND b.fs = 'selected'""")
def full_vs_selected(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("fs", F.when(F.col("p_size") <= 25, "full").otherwise("selected"))
    results = part.groupBy(F.col("p_brand").alias("scenario"), "fs").agg(F.avg("p_retailprice").alias("mae"), F.count(F.lit(1)).alias("n"))
    return rounded(joins.side_by_side(results, ["scenario"], "fs", ["full", "selected"], ["mae", "n"]))


@query(f"SELECT p_partkey, {r4('0.7 * p_retailprice / (SELECT max(p_retailprice) FROM part) + 0.3 * CAST(p_size AS DOUBLE) / (SELECT max(p_size) FROM part)')} AS score FROM part")
def combined_score(spark, sf_dir):
    return rounded(selection.scored(table(spark, sf_dir, "part").withColumn("p_size", F.col("p_size").cast("double")), "p_partkey", {"p_retailprice": 0.7, "p_size": 0.3}))


@query("SELECT p_brand, arg_min(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS cheapest, arg_max(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS dearest FROM part GROUP BY 1")
def arg_best(spark, sf_dir):
    place = F.struct("p_retailprice", "p_partkey")
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by("p_partkey", place).alias("cheapest"), F.max_by("p_partkey", place).alias("dearest"))


@query(f"""WITH {PROXY}, t AS (SELECT CAST(station AS DOUBLE) AS station, rain, proxy, 1.0::DOUBLE AS same, NULL::DOUBLE AS nothing FROM p)
SELECT c AS column, {r4('m')} AS missing, n AS distinct, CASE WHEN n = 0 THEN 'all_missing' WHEN m > 0.4 THEN 'too_sparse' WHEN n = 1 THEN 'constant' ELSE 'ok' END AS verdict FROM (""" + " UNION ALL ".join(f"SELECT '{c}' AS c, (count(*) - count({c})) / count(*)::DOUBLE AS m, count(DISTINCT {c}) AS n FROM t" for c in ("station", "rain", "proxy", "same", "nothing")) + ")")
def technical_filter(spark, sf_dir):
    df = proxied(spark, sf_dir).withColumns({"same": F.lit(1.0), "nothing": F.lit(None).cast("double")})
    return rounded(selection.technical(df, ["station", "rain", "proxy", "same", "nothing"]))


PRUNED = ["l_quantity", "l_quantity_2", "l_discount", "l_tax"]
PRUNED_RANKS = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS {c}" for c in PRUNED)
PRUNED_PAIRS = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM k" for a in PRUNED for b in PRUNED if a != b)


@query(f"""WITH RECURSIVE n AS (SELECT l_quantity, l_quantity * l_quantity AS l_quantity_2, l_discount, l_tax FROM lineitem), k AS (SELECT {PRUNED_RANKS} FROM n), c AS ({PRUNED_PAIRS}),
f AS (SELECT * FROM (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(PRUNED, 1))}) AS t(i, name)),
x AS (SELECT f.i, f.name, coalesce(list(c.b) FILTER (abs(c.r) >= 0.95), []) AS close FROM f LEFT JOIN c ON c.a = f.name GROUP BY 1, 2),
g AS (SELECT 0 AS i, CAST([] AS VARCHAR[]) AS kept UNION ALL SELECT x.i, CASE WHEN len(g.kept) < 3 AND NOT list_has_any(g.kept, x.close) THEN list_append(g.kept, x.name) ELSE g.kept END FROM g JOIN x ON x.i = g.i + 1),
l AS (SELECT kept FROM g ORDER BY i DESC LIMIT 1)
SELECT CAST(place AS INTEGER) AS place, kept[place] AS feature FROM (SELECT kept, unnest(range(1, len(kept) + 1)) AS place FROM l)""")
def correlation_pruning(spark, sf_dir):
    names = PRUNED
    df = table(spark, sf_dir, "lineitem").withColumn("l_quantity_2", F.col("l_quantity") * F.col("l_quantity"))
    pairs = {(r.a, r.b): r.r for r in stats.spearman_pairs(df, names).collect()}  # a row for each pair of columns
    kept = selection.pruned(names, pairs, most=3)
    return spark.createDataFrame(list(enumerate(kept, 1)), "place int, feature string")


@query(f"WITH t AS (SELECT p_partkey, CASE WHEN p_size < 25 THEN CAST(p_size AS DOUBLE) END AS size FROM part) SELECT p_partkey, {r4('coalesce(size, (SELECT median(size) FROM t WHERE p_partkey % 2 = 0))')} AS size FROM t")
def median_imputation(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 25, F.col("p_size").cast("double")).alias("size"))
    train, rest = impute.fill_with_medians(df.where("p_partkey % 2 = 0"), [df.where("p_partkey % 2 <> 0")], ["size"])
    return rounded(train.unionByName(rest))


@query("SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS rank FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 25")
def topk_ranked(spark, sf_dir):
    best = eda.top(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), F.col("p_retailprice"), "p_partkey", 25)
    return eda.ranked(best, "p_retailprice", "p_partkey").withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT column_name AS name FROM (DESCRIBE SELECT * FROM lineitem) WHERE column_type IN ('DOUBLE', 'FLOAT', 'BIGINT', 'INTEGER') AND column_name NOT IN ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_tax')")
def feature_columns(spark, sf_dir):
    names = numeric_columns(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_tax"])
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(f"SELECT {LINE}, coalesce(CASE WHEN l_quantity > 25 THEN l_quantity END, l_tax) AS a, coalesce(CASE WHEN l_discount > 0.05 THEN l_discount END, l_quantity) AS b FROM lineitem")
def filled_from_grid(spark, sf_dir):
    df = lines(spark, sf_dir, F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("a"), F.when(F.col("l_discount") > 0.05, F.col("l_discount")).alias("b"), F.col("l_tax").alias("c"), F.col("l_quantity").alias("d"))
    return df.withColumns(impute.filled_from({"a": "c", "b": "d"})).drop("c", "d")


@query(f"""WITH x AS (SELECT *, l_quantity AS a, l_discount * 10 AS b, l_tax AS c, l_extendedprice / 1000 AS d FROM lineitem)
SELECT {LINE}, {r4('a * d')} AS moist_convection_500, {r4('a - b')} AS dew_point_depression, {r4('c - a')} AS du_850_500, {r4('d - b')} AS dv_850_500, {r4('sqrt((c - a) * (c - a) + (d - b) * (d - b))')} AS wind_shear_mag, {r4('d - c')} AS elevation_diff FROM x""")
def physical_features_rest(spark, sf_dir):
    a, b, c, d = F.col("l_quantity"), F.col("l_discount") * 10, F.col("l_tax"), F.col("l_extendedprice") / 1000
    named = lines(spark, sf_dir, a.alias("q_500"), d.alias("w_500"), a.alias("TEMP"), b.alias("DEWP"), c.alias("u_850"), a.alias("u_500"), d.alias("v_850"), b.alias("v_500"), d.alias("ELEVATION"), c.alias("z"))
    return rounded(features.physical(named).drop("q_500", "w_500", "TEMP", "DEWP", "u_850", "u_500", "v_850", "v_500", "ELEVATION", "z"))


@query(f"WITH {FRAME}, x AS (SELECT station, time, rain - lag(rain) {W}) AS du_dt_850, 2 * rain - lag(2 * rain) {W}) AS dv_dt_850 FROM f) SELECT station, time, {r4('du_dt_850')} AS du_dt_850, {r4('dv_dt_850')} AS dv_dt_850, {r4('sqrt(du_dt_850 * du_dt_850 + dv_dt_850 * dv_dt_850)')} AS ageostrophic_signal FROM x")
def tendencies(spark, sf_dir):
    df = dense(spark, sf_dir).withColumns({"u_850": F.col("rain"), "v_850": 2 * F.col("rain")})
    return rounded(features.tendencies(df, "station", "time").drop("rain", "u_850", "v_850"))


@query(f"WITH {FRAME}, x AS (SELECT station, time, greatest(rain - 50, 0.0) AS a FROM f WHERE rain IS NOT NULL) SELECT station, time, {r4('a')} AS target_1stage_prcp_mm, CAST(a >= 0.1 AS INTEGER) AS target_stage1_rain_label, {r4('ln(1 + a)')} AS target_stage2_prcp_log1p FROM x")
def targets_clipped(spark, sf_dir):
    df = dense(spark, sf_dir).where("rain is not null").withColumn("rain", F.col("rain") - 50)
    return rounded(features.targets(df, "rain", clip=True).drop("rain"))


@query("SELECT event_id, strftime(ts, '%b') AS month_name FROM events")
def month_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", month_name("ts").alias("month_name"))


@query("SELECT 'train' AS part, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1995 AND 1998 UNION ALL SELECT 'valid', count(*) FROM orders WHERE year(o_orderdate) = 1999 UNION ALL SELECT 'test', count(*) FROM orders WHERE year(o_orderdate) = 2000")
def year_split_parts(spark, sf_dir):
    parts = validate.split_by_year(table(spark, sf_dir, "orders"), "o_orderdate", (1995, 1998), 1999, 2000)
    counts = [p.agg(F.lit(n).alias("part"), F.count(F.lit(1)).alias("n")) for n, p in zip(("train", "valid", "test"), parts, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("SELECT p_partkey, p_retailprice, coalesce(r, 0.0) AS r FROM part LEFT JOIN (SELECT ps, CAST(count(*) AS DOUBLE) AS r FROM (SELECT l_partkey AS ps FROM lineitem WHERE l_quantity > 45) GROUP BY 1) ON ps = p_partkey")
def importance_with_correlation(spark, sf_dir):
    side = table(spark, sf_dir, "lineitem").where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).cast("double").alias("r"))
    return selection.with_correlation(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), side, "p_partkey")


@query(f"WITH {DAYS}, x AS (SELECT *, ln(1 + rain) AS l FROM d) SELECT 'rain_not_negative' AS rule, CAST(0 AS BIGINT) + count(*) FILTER (rain < 0) AS violations FROM x UNION ALL SELECT 'label_follows_rain', count(*) FILTER ((rain >= 30) <> (rain >= 0.1)) FROM x UNION ALL SELECT 'amount_is_rain', count(*) FILTER (rain > 80) FROM x UNION ALL SELECT 'log_is_log1p', count(*) FILTER (rain > 80) FROM x UNION ALL SELECT 'rain_finite', count(*) FILTER (NOT isfinite(rain)) FROM x")
def gold_gate(spark, sf_dir):
    rain = F.col("rain")
    df = days(spark, sf_dir).withColumns({"target_1stage_prcp_mm": F.when(rain > 80, rain + 1).otherwise(rain), "target_stage1_rain_label": (rain >= 30).cast("int"), "target_stage2_prcp_log1p": F.when(rain > 80, F.log1p(rain) + 1).otherwise(F.log1p(rain))})
    return validate.violations(df, validate.gold_rules("rain"))


#: The evaluation's settings with few rounds: a query shows the method and not the last decimal of a score.
FEW = replace(boosting.EVALUATION, rounds=5, rate=0.1, leaves=8)


@query()
def two_stage_glm(spark, sf_dir):
    """Persistence, the linear one-stage and the boosted two-stage model on the frame: train on 17 days, stop the boosting by 4, test on the rest."""
    df, _ = store.written(targets_frame(spark, sf_dir).na.drop(), "frame")  # models read it many times
    day = F.dayofyear("time")
    inputs = ["lag_1", "lag_2", "mean_3d", "sum_3d"]
    parts = {"train": df.where(day <= 17), "valid": df.where((day > 17) & (day <= 21)), "test": df.where(day > 21)}
    return models.live_benchmark(parts, inputs, inputs[:2], lagged="lag_1", settings=FEW, linear=True)


def targets_frame(spark, sf_dir) -> DataFrame:
    return features.targets(prcp_proxy(spark, sf_dir).drop("proxy"), "rain")


PARTS = ["l_quantity", "l_discount", "l_tax", "l_linenumber", "lag_days"]


def priced(spark, sf_dir) -> DataFrame:
    """Lines with a price that is often 0, as rain is, and its targets; written once, since models read them many times."""
    df = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    amount = F.when(F.col("l_quantity") * (1 + F.col("l_linenumber")) > 60, F.round(F.col("l_extendedprice") / 1000, 2)).otherwise(0.0)
    made = features.targets(df.withColumns({"rain": amount, "lag_days": F.date_diff("l_shipdate", "o_orderdate").cast("double")}), "rain")
    return store.written(made.select("l_orderkey", *PARTS, "rain", *[c for c in made.columns if c.startswith("target_")]), "lines")[0]


@query()
def boosted_tweedie(spark, sf_dir):
    """``model, deviance``: mean Tweedie loss on the lines of every fourth order, which neither model saw; trees stop by those of another fourth."""
    df = priced(spark, sf_dir)
    part = F.col("l_orderkey") % 4
    train, valid, test = df.where(part < 2), df.where(part == 2), df.where(part == 3)
    trees = models.one_stage(train, PARTS, "rain", valid, replace(boosting.EVALUATION, rounds=12, rate=0.2))
    line = models.tweedie(train, PARTS, "rain")
    loss = F.avg(F.pow("prediction", 0.7) / 0.7 + F.col("rain") * F.pow("prediction", -0.3) / 0.3)
    rows = [predict(test).agg(loss.alias("deviance")).select(F.lit(name).alias("model"), "deviance") for name, predict in (("trees", trees.predict), ("linear", line))]
    return rows[0].unionByName(rows[1])


@query()
def boosted_importances(spark, sf_dir):
    """``feature``, the number of its splits in three models, and the score by the fixed weights, with rank correlations."""
    df = priced(spark, sf_dir)
    splits = models.importances(df, PARTS, settings=replace(boosting.SELECTION, rounds=5, leaves=8)).select("feature", *[c for c in selection.WEIGHTS if c.startswith("importance")])
    pairs = stats.spearman_pairs(df.withColumn("rainy", F.col("target_stage1_rain_label").cast("double")), [*PARTS, "rain", "rainy"], [(c, t) for c in PARTS for t in ("rain", "rainy")])
    pairs, _ = store.written(pairs, "ranks")  # a row for each pair, read twice by the score
    by = [pairs.where(F.col("b") == t).select(F.col("a").alias("feature"), F.abs("r").alias(name)) for t, name in (("rain", "abs_spearman"), ("rainy", "abs_spearman_rain"))]
    correlations = by[0].join(by[1], "feature")
    return splits.join(models.combined(splits, correlations), "feature")


# ---- contracts, order, publishing, arrays

#: (column, type in Spark, least, greatest, least number of known values) of a table that is nearly ``lineitem``.
CODEBOOK = [
    ("l_orderkey", "bigint", 0, None, 1), ("l_quantity", "double", 1, 50, 1), ("l_discount", "double", 0, 0.05, 1), ("l_tax", "float", 0, 0.08, 1),
    ("l_linestatus", "string", None, None, 10**12), ("l_shipdate", "timestamp_ntz", None, None, 1), ("l_colour", "string", None, None, 1),
]
PROFILED = ("l_orderkey", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_linestatus", "l_shipdate")


@query("WITH p AS (" + " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS known, {f'CAST(min({c}) AS DOUBLE)' if n else 'NULL::DOUBLE'} AS least, {f'CAST(max({c}) AS DOUBLE)' if n else 'NULL::DOUBLE'} AS greatest, '{k}' AS kind FROM lineitem" for c, k, n in zip(PROFILED, ("bigint", "bigint", "double", "double", "double", "string", "timestamp_ntz"), (1, 1, 1, 1, 1, 0, 0), strict=True)) + "), b AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{k}', {'NULL' if lo is None else lo}::DOUBLE, {'NULL' if hi is None else hi}::DOUBLE, {n})" for c, k, lo, hi, n in CODEBOOK) + ") AS t(\"column\", declared, low, high, least_known)) " + """
SELECT coalesce(p.column, b.column) AS column, CASE WHEN p.column IS NULL THEN 'absent' WHEN b.column IS NULL THEN 'extra' WHEN declared <> kind THEN 'mistyped' WHEN known < least_known THEN 'too_few'
  WHEN least < low OR greatest > high THEN 'out_of_range' ELSE 'ok' END AS verdict, known, least, greatest FROM p FULL JOIN b ON p.column = b.column""")
def codebook_contract(spark, sf_dir):
    book = spark.createDataFrame([(c, k, None if lo is None else float(lo), None if hi is None else float(hi), n) for c, k, lo, hi, n in CODEBOOK], "column string, type string, low double, high double, least_known bigint")
    return validate.against_codebook(table(spark, sf_dir, "lineitem").select(*PROFILED), book)


@query("""WITH q AS (SELECT l_suppkey, l_returnflag AS flag, l_linenumber AS line, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)
SELECT s.l_suppkey, f.flag, CAST(k.line AS BIGINT) AS line, q.quantity, coalesce(q.n, 0) AS n FROM (SELECT DISTINCT l_suppkey FROM lineitem) s CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS flag) f
CROSS JOIN (SELECT unnest(range(1, 8)) AS line) k LEFT JOIN q ON q.l_suppkey = s.l_suppkey AND q.flag = f.flag AND q.line = k.line""")
def array_cells(spark, sf_dir):
    """Sums by supplier as 3 x 7 arrays over flag and line number, and back to rows by position."""
    flags, numbers = ["A", "N", "R"], list(range(1, 8))
    line = lines(spark, sf_dir, "l_returnflag", "l_quantity")
    at = [(F.col("l_returnflag") == f) & (F.col("l_linenumber") == k) for f in flags for k in numbers]
    sums, counts = [F.sum(F.when(c, F.col("l_quantity"))) for c in at], [F.count_if(c) for c in at]
    nested = F.array(*[F.array(*sums[i : i + 7]) for i in range(0, 21, 7)])
    held = line.groupBy("l_suppkey").agg(nested.alias("quantity"), F.array(*counts).alias("n"))
    held = held.withColumns({"flags": F.array(*[F.lit(f) for f in flags]), "lines": F.array(*[F.lit(k).cast("bigint") for k in numbers])})
    return frame.array_rows(held, ["quantity", "n"], [("flag", "flags"), ("line", "lines")])


def ordered_orders(spark, sf_dir) -> str:
    from pluvial.sources import files

    uri = store.fresh_uri(spark, "ordered")
    files.write_ordered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority"), uri, ["o_totalprice", "o_orderkey"])
    return uri


@query("SELECT o_orderkey, o_totalprice, o_orderpriority, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS row FROM orders")
def ordered_rows(spark, sf_dir):
    """All orders written in one order over the files, read back with their numbers."""
    from pluvial.sources import files

    return files.read_numbered(spark, ordered_orders(spark, sf_dir))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def preview_rows(spark, sf_dir):
    from pluvial.sources import files

    return files.preview(spark, ordered_orders(spark, sf_dir))


@query("""WITH v AS (SELECT count(*) AS n, count(*) FILTER (NOT coalesce(o_totalprice > 0, false)) AS a, count(*) FILTER (NOT coalesce(o_totalprice <= 400000, false)) AS b, count(*) FILTER (o_orderkey IS NULL) AS k, count(DISTINCT o_custkey) AS g,
  (SELECT count(*) FROM (SELECT max(o_totalprice) AS m FROM orders GROUP BY o_custkey) WHERE NOT m >= 1000) AS c FROM orders)
SELECT 'orders_positive' AS "check", CASE WHEN a = 0 THEN 'PASS' ELSE 'FAIL' END AS status, a AS violations, n AS rows FROM v
UNION ALL SELECT 'orders_bounded', CASE WHEN b = 0 THEN 'PASS' WHEN b <= 0.9 * n THEN 'WARNING' ELSE 'FAIL' END, b, n FROM v UNION ALL SELECT 'orders_known', CASE WHEN k = 0 THEN 'PASS' ELSE 'FAIL' END, k, n FROM v
UNION ALL SELECT 'customers_large', CASE WHEN c = 0 THEN 'PASS' WHEN c <= 0.5 * g THEN 'WARNING' ELSE 'FAIL' END, c, g FROM v""")
def published_checks(spark, sf_dir):
    """Largest orders by customer, published through a gate; the report of what was counted while they were written."""
    from . import gates

    audit, price = validate.Audit(), F.col("o_totalprice")
    orders = audit.watch(table(spark, sf_dir, "orders"), "orders", {"positive": price > 0, "bounded": price <= 400000, "known": F.col("o_orderkey").isNotNull()}, {"bounded": 0.9})
    best = orders.groupBy("o_custkey").agg(F.max("o_totalprice").alias("top"))
    root = store.fresh_uri(spark, "gate")
    gates.publish(best, root, "customers", {"large": F.col("top") >= 1000}, {"large": 0.5}, audit)
    return gates.report(spark, root, "customers")


#: Columns of ``lineitem`` under names whose groups differ.
NAMED = {"TEMP": "l_quantity", "u_850": "l_discount", "TEMP_lag_1": "l_tax", "STATION": "l_suppkey", "dew_point_depression": "l_extendedprice", "other": "l_partkey"}
NAMED_GROUPS = {"TEMP": "gsod_surface", "u_850": "era5_pressure_850hpa", "TEMP_lag_1": "lag_rolling", "STATION": "metadata_time", "dew_point_depression": "thermodynamic", "other": "other_engineered"}


@query("WITH m AS (" + " UNION ALL ".join(f"SELECT '{NAMED_GROUPS[c]}' AS g, count(*) FILTER ({x} > 10) * 100.0::DOUBLE / count(*) AS p FROM lineitem" for c, x in NAMED.items()) + f""") SELECT g AS "group", count(*) AS columns, {r4('avg(p)')} AS average, {r4('max(p)')} AS largest, {r4('min(p)')} AS smallest FROM m GROUP BY 1""")
def missing_by_feature_group(spark, sf_dir):
    """Missing values by the group that a column's name belongs to; values over 10 count as missing."""
    df = table(spark, sf_dir, "lineitem").select(*[F.when(F.col(x) <= 10, F.col(x)).alias(c) for c, x in NAMED.items()])
    return rounded(eda.group_missingness(eda.missing_per_column(df), {c: feature_group(c) for c in df.columns}))


@query(f"""WITH i AS (SELECT l_partkey AS feature, sum(l_quantity) AS importance_tweedie, sum(l_discount) AS importance_stage1_cls, sum(l_tax) AS importance_stage2_wet FROM lineitem GROUP BY 1),
c AS (SELECT p_partkey AS feature, p_retailprice AS abs_spearman, CAST(p_size AS DOUBLE) AS abs_spearman_rain FROM part WHERE p_size > 10),
b AS (SELECT i.*, coalesce(abs_spearman, 0) AS s, coalesce(abs_spearman_rain, 0) AS r FROM i LEFT JOIN c ON c.feature = i.feature)
SELECT feature, {r4('0.35 * importance_tweedie / (SELECT max(importance_tweedie) FROM b) + 0.25 * importance_stage1_cls / (SELECT max(importance_stage1_cls) FROM b) + 0.25 * importance_stage2_wet / (SELECT max(importance_stage2_wet) FROM b) + 0.1 * s / (SELECT max(s) FROM b) + 0.05 * r / (SELECT max(r) FROM b)')} AS score FROM b""")
def weighted_score(spark, sf_dir):
    """The fixed weights on five parts, with parts standing for features."""
    sums = {"importance_tweedie": "l_quantity", "importance_stage1_cls": "l_discount", "importance_stage2_wet": "l_tax"}
    i = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("feature")).agg(*[F.sum(x).alias(n) for n, x in sums.items()])
    c = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("feature"), F.col("p_retailprice").alias("abs_spearman"), F.col("p_size").cast("double").alias("abs_spearman_rain"))
    return rounded(models.combined(i, c))


# ---- silver and gold from a stand-in: events make observations and both grids

FIRST_DAY, LAST_DAY = "2024-01-01", "2024-01-30"
#: Expressions that both languages read, over n, lo and hi of a station's events of a day, or of six hours.
OBSERVATION = {
    "LATITUDE": "CASE WHEN n <= 5 THEN {lat} + 0.05 END", "LONGITUDE": "CASE WHEN n <= 5 THEN {lon} + 0.05 END", "ELEVATION": "CAST(user_id % 97 AS DOUBLE)",
    "TEMP": "CASE WHEN n % 5 = 4 THEN 9999.9D ELSE lo + 30 END", "DEWP": "CASE WHEN n % 5 = 3 THEN 9999.9D ELSE lo END", "PRCP": "CASE WHEN n % 3 = 0 THEN 99.99D WHEN n % 3 = 1 THEN hi / 100 ELSE 0D END",
    "WDSP": "CASE WHEN n % 4 = 3 THEN 999.9D ELSE hi / 10 END", "STP": "CASE WHEN n % 2 = 0 THEN 9999.9D ELSE 700 + lo * 4 END", "SLP": "CASE WHEN n % 3 = 2 THEN 9999.9D ELSE 900 + hi END", "VISIB": "CASE WHEN n % 3 > 0 THEN 999.9D ELSE hi / 10 END",
}
SURFACE = {"t2m": "270 + hi / 4", "d2m": "265 + lo / 4", "sst": "lo * 0 + 290", "u10": "lo / 10", "v10": "hi / 10", "sp": "90000 + hi * 100", "msl": "95000 + lo * 100", "z": "user_id % 50 * 9", "lsm": "user_id % 7 / 8"}
ALOFT = {500: {"z": "57000 + hi * 10", "t": "250 + lo / 10", "q": "lo / 1000", "u": "hi / 7", "v": "lo / 7", "w": "lo / 900"}, 850: {"z": "15000 + lo * 10", "t": "280 + hi / 10", "q": "hi / 1000", "u": "lo / 9", "v": "hi / 9", "w": "hi / 800"}}
LATITUDE, LONGITUDE = "(CASE WHEN user_id % 61 = 60 THEN 30 ELSE 8 + 0.25D * (user_id % 61) END)", "(102 + 0.25D * (CAST(floor(user_id / 61) AS BIGINT) % 30))"


def stand_in(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations and both grids, in the sources' schemas and units; users of one cell are the pressure grid's members."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "value")
    sums = [F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")]
    days = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(*sums)
    made = {c: F.expr(e.format(lat=LATITUDE, lon=LONGITUDE)) for c, e in OBSERVATION.items()}
    bronze = days.select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("STATION"), F.when(F.col("n") == 6, "no day").otherwise(F.col("day").cast("string")).alias("DATE"), *[e.alias(c) for c, e in made.items()])
    six = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 21600) * 21600).cast("timestamp_ntz")
    hours = events.groupBy("user_id", six.alias("time")).agg(*sums)
    cell = [F.expr(e).cast("float").alias(c) for c, e in (("latitude", LATITUDE), ("longitude", LONGITUDE))]
    single = hours.select("time", *cell, *[F.expr(e).cast("float").alias(c) for c, e in SURFACE.items()])
    levels = [hours.where("n < 3" if level == 850 else "true").select("time", *cell, F.col("user_id").alias("number"), F.lit(level).alias("isobaricInhPa"), *[F.expr(e).cast("float").alias(c) for c, e in own.items()]) for level, own in ALOFT.items()]
    return bronze, single, levels[0].unionByName(levels[1])


def _duck(e: str) -> str:
    """Double literals as DuckDB writes them."""
    import re

    return re.sub(r"([0-9.]+)D\b", r"CAST(\1 AS DOUBLE)", e)


def _float4(x: str) -> str:
    f = f"CAST(({x}) AS FLOAT)"
    return f"CAST(CAST(CAST(round_even(CAST({f} * CAST(10000 AS FLOAT) AS FLOAT), 0) AS FLOAT) / CAST(10000 AS FLOAT) AS VARCHAR) AS DOUBLE)"


def _round(x: str) -> str:
    return f"(round_even(({x}) * 10000, 0) / 10000)"


MARK = "CASE WHEN abs({c} - CAST({m} AS DOUBLE)) <= 1e-3 + 1e-5 * {m} THEN NULL ELSE {c} END"
METRIC = {"TEMP": "({x} + (-32.0)) * (5.0::DOUBLE / 9.0::DOUBLE)", "DEWP": "({x} + (-32.0)) * (5.0::DOUBLE / 9.0::DOUBLE)", "PRCP": "({x} + 0.0) * 25.4", "WDSP": "({x} + 0.0) * 0.514444", "VISIB": "({x} + 0.0) * 1.60934", "STP": "CASE WHEN {x} BETWEEN 800 AND 1100 THEN {x} END", "SLP": "CASE WHEN {x} BETWEEN 800 AND 1100 THEN {x} END"}
MARKS_SQL = {"TEMP": 9999.9, "DEWP": 9999.9, "PRCP": 99.99, "WDSP": 999.9, "STP": 9999.9, "SLP": 9999.9, "VISIB": 999.9}
PLACES = ("LATITUDE", "LONGITUDE", "ELEVATION")
CHANGED = {"t2m": "{x} - CAST(273.15 AS FLOAT)", "d2m": "{x} - CAST(273.15 AS FLOAT)", "msl": "{x} / CAST(100 AS FLOAT)", "sp": "{x} / CAST(100 AS FLOAT)", "z": "{x} / CAST(9.80665 AS FLOAT)", "t": "{x} - CAST(273.15 AS FLOAT)"}
BOX = f"{_duck(LATITUDE)} BETWEEN 8 AND 24 AND {_duck(LONGITUDE)} BETWEEN 102 AND 110"


def _single(c: str) -> str:
    return CHANGED.get(c, "{x}").format(x=f"CAST({_duck(SURFACE[c])} AS FLOAT)")


def _aloft(level: int, v: str) -> str:
    return CHANGED.get(v, "{x}").format(x=f"CAST({_duck(ALOFT[level][v])} AS FLOAT)")


STATION_WINDOW = "OVER (PARTITION BY STATION ORDER BY time"
SILVER = f"""a AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2),
b AS (SELECT 's' || user_id AS STATION, day AS time, {', '.join(f"{_duck(e.format(lat=LATITUDE, lon=LONGITUDE))} AS {c}" for c, e in OBSERVATION.items())} FROM a WHERE n <> 6),
o AS (SELECT STATION, time, {', '.join(METRIC[c].format(x='(' + MARK.format(c=c, m=m) + ')') + f' AS {c}' for c, m in MARKS_SQL.items())} FROM b),
place AS (SELECT STATION, {', '.join(f'arg_min({c}, time) FILTER ({c} IS NOT NULL) AS {c}' for c in PLACES)} FROM b GROUP BY 1),
span AS (SELECT CAST(unnest(generate_series(TIMESTAMP '{FIRST_DAY}', TIMESTAMP '{LAST_DAY}', INTERVAL 1 DAY)) AS DATE) AS time),
d AS (SELECT p.*, span.time, {', '.join(f'o.{c}' for c in MARKS_SQL)}, {', '.join(f'round_even(round_even(p.{c} / 0.25, 0) * 0.25 * 100, 0) / 100 AS {n}' for c, n in (('LATITUDE', 'cell_lat'), ('LONGITUDE', 'cell_lon')))}
  FROM place p CROSS JOIN span LEFT JOIN o ON o.STATION = p.STATION AND o.time = span.time),
h AS (SELECT user_id, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') AS six, count(*) AS n, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1, 2),
hc AS (SELECT *, CAST(six AS DATE) AS day, {_duck(LATITUDE)} AS lat, {_duck(LONGITUDE)} AS lon FROM h WHERE {BOX}),
s1 AS (SELECT lat, lon, day, {', '.join(f'CAST(avg({_single(c)}) AS FLOAT) AS {c}' for c in SURFACE if c != 'lsm')}, arg_min({_single('lsm')}, six) AS lsm FROM hc GROUP BY 1, 2, 3),
s2 AS (SELECT lat, lon, day, {', '.join(f'{_float4(c)} AS {c}' for c in SURFACE)} FROM s1),
w AS (SELECT lat, lon, day, {', '.join(f'{_aloft(level, v)} AS {v}_{level}' for level in ALOFT for v in ALOFT[level])} FROM hc WHERE n < 3),
p1 AS (SELECT lat, lon, day, {', '.join(f'CAST(avg({v}_{level}) AS FLOAT) AS {v}_{level}' for level in ALOFT for v in ALOFT[level])} FROM w GROUP BY 1, 2, 3),
p2 AS (SELECT lat, lon, day, {', '.join(f'{_float4(f"{v}_{level}")} AS {v}_{level}' for level in ALOFT for v in ALOFT[level])} FROM p1),
j AS (SELECT d.*, {', '.join(f's2.{c}' for c in SURFACE)} FROM d LEFT JOIN s2 ON s2.lat = d.cell_lat AND s2.lon = d.cell_lon AND s2.day = d.time),
k AS (SELECT * REPLACE ({', '.join(f'coalesce(last_value({c} IGNORE NULLS) {STATION_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value({c} IGNORE NULLS) {STATION_WINDOW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}' for c in ('z', 'lsm'))},
  coalesce(TEMP, t2m) AS TEMP, coalesce(DEWP, d2m) AS DEWP, coalesce(SLP, msl) AS SLP, coalesce(STP, sp) AS STP, coalesce(WDSP, sqrt(u10 * u10 + v10 * v10)) AS WDSP) FROM j),
v1 AS (SELECT * REPLACE (last_value(VISIB IGNORE NULLS) {STATION_WINDOW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS VISIB) FROM k),
v2 AS (SELECT * REPLACE (coalesce(VISIB, median(VISIB) OVER (PARTITION BY STATION, month(time))) AS VISIB) FROM v1),
v3 AS (SELECT * REPLACE (coalesce(VISIB, median(VISIB) OVER (PARTITION BY STATION)) AS VISIB) FROM v2),
v4 AS (SELECT * REPLACE (coalesce(VISIB, (SELECT median(VISIB) FROM v3)) AS VISIB) FROM v3),
silver AS (SELECT STATION, v4.time, {', '.join(f'{_round(c)} AS {c}' for c in (*PLACES, 'TEMP', 'PRCP', 'WDSP', 'DEWP', 'STP', 'SLP', 'VISIB', 'u10', 'v10', 'z', 'lsm', *(f'{v}_{level}' for level in ALOFT for v in ALOFT[level])))}
  FROM v4 LEFT JOIN p2 ON p2.lat = v4.cell_lat AND p2.lon = v4.cell_lon AND p2.day = v4.time)"""
SILVER_NUMBERS = (*PLACES, "TEMP", "PRCP", "WDSP", "DEWP", "STP", "SLP", "VISIB", "u10", "v10", "z", "lsm", *(f"{v}_{level}" for level in ALOFT for v in ALOFT[level]))


@query(f"WITH {SILVER} SELECT STATION, time, {', '.join(f'{r4(c)} AS {c}' for c in SILVER_NUMBERS)} FROM silver")
def silver_table(spark, sf_dir):
    """Observations and both grids to dense, imputed station-days."""
    from . import medallion

    bronze, single, pressure = stand_in(spark, sf_dir)
    out = medallion.silver(bronze, medallion.single_daily(single), medallion.pressure_daily(pressure), FIRST_DAY, LAST_DAY)
    return rounded(out.select("STATION", "time", *SILVER_NUMBERS))


LAST3 = f"{STATION_WINDOW} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"
GOLD = {
    "PRCP": "PRCP", "PRCP_impute": "PRCP_impute", "day_sin": f"sin({TURN} * dayofyear(time) / 365)", "month_cos": f"cos({TURN} * month(time) / 12)", "moist_convection_850": "q_850 * w_850",
    "lapse_rate_850_500": "(t_850 - t_500) / nullif(z_500 - z_850, 0)", "dew_point_depression": "TEMP - DEWP", "wind_shear_mag": "sqrt((u_850 - u_500) * (u_850 - u_500) + (v_850 - v_500) * (v_850 - v_500))",
    "thickness_500_850": "z_500 - z_850", "elevation_diff": "ELEVATION - z", "moisture_flux_850": "flux", "du_dt_850": f"u_850 - lag(u_850) {STATION_WINDOW})", "PRCP_lag_1": f"lag(rain) {STATION_WINDOW})", "PRCP_lag_2": f"lag(rain, 2) {STATION_WINDOW})",
    "TEMP_lag_1": f"lag(TEMP) {STATION_WINDOW})", "VISIB_3d_mean": f"avg(VISIB) {LAST3}", "moisture_flux_3d_sum": f"sum(flux) {LAST3}", "PRCP_past_3d_mean": f"avg(rain) {LAST3}", "PRCP_past_3d_sum": f"sum(rain) {LAST3}",
    "target_1stage_prcp_mm": "PRCP", "target_stage2_prcp_log1p": "ln(1 + PRCP)",
}


@query(f"""WITH {SILVER}, g1 AS (SELECT *, q_850 * sqrt(u_850 * u_850 + v_850 * v_850) AS flux, CASE WHEN PRCP IS NULL THEN coalesce(last_value(PRCP IGNORE NULLS) {STATION_WINDOW} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
  quantile_cont(PRCP, 0.5) OVER (PARTITION BY STATION, month(time) ORDER BY time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), quantile_cont(PRCP, 0.5) {STATION_WINDOW} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) END AS PRCP_impute FROM silver),
g2 AS (SELECT *, coalesce(PRCP, PRCP_impute) AS rain FROM g1)
SELECT STATION, time, {', '.join(f'{r4(e)} AS {c}' for c, e in GOLD.items())}, CAST(PRCP >= 0.1 AS INTEGER) AS target_stage1_rain_label FROM g2""")
def gold_table(spark, sf_dir):
    """The gold table, written once with its checks counted; a column of each family is compared."""
    from . import medallion

    out = medallion.gold(*stand_in(spark, sf_dir), FIRST_DAY, LAST_DAY)
    return rounded(out.select("STATION", "time", *GOLD, "target_stage1_rain_label"))
