"""Operators on small fixtures, against pandas or plain arithmetic."""

import json
import math
from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pluvial.functions import columns as cols
from pluvial.functions import expr
from pluvial.operators import boosting, eda, features, frame, impute, joins, metrics, models, selection, stats, validate
from pluvial.operators import windows as win
from pluvial.plans import medallion
from pluvial.sources import fetch, files, schemas
from pluvial.streaming import daily


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("mark, value, gone", [(9999.9, 9999.8, True), (9999.9, 9999.79, False), (99.99, 99.989, True), (99.99, 99.98, False), (999.9, 999.9, True)])
def test_marks(spark, mark, value, gone):
    assert (one(spark, expr.missing_marked(F.lit(value), mark)) is None) == gone


@pytest.mark.parametrize("value, kept", [(800.0, True), (1100.0, True), (799.9, False), (12.3, False)])
def test_range(spark, value, kept):
    assert (one(spark, expr.within(F.lit(value), 800, 1100)) is not None) == kept


def test_rounding_is_numpys(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=500) * 100, [0.00005, 0.00015, 0.12345, -0.00005]])
    got = [r.x for r in spark.createDataFrame([(float(v),) for v in x], "v double").select(expr.round4(F.col("v")).alias("x")).collect()]
    assert got == np.round(x, 4).tolist()
    f = x.astype(np.float32)
    got = [r.x for r in spark.createDataFrame([(float(v),) for v in f], "v float").select(expr.round4_float(F.col("v")).alias("x")).collect()]
    assert np.asarray(got, np.float32).tolist() == np.round(f, 4).tolist()
    kelvin = [r.x for r in spark.createDataFrame([(float(v),) for v in f], "v float").select(expr.celsius(F.col("v")).alias("x")).collect()]
    assert np.asarray(kelvin, np.float32).tolist() == (f - np.float32(273.15)).tolist()


def test_quantized_half_even(spark):
    assert [one(spark, expr.quantized(F.lit(v))) for v in (10.125, 10.375, 10.126, -0.125)] == [10.0, 10.5, 10.25, -0.0]


def test_text_to_numbers(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("NaN",)], "t string")
    assert [r.x for r in df.select(expr.numeric(F.col("t")).alias("x")).collect()] == [1.5, None, None, None]


def station_rows(seed=3, days=40, gaps=0.35):
    rng = np.random.default_rng(seed)
    out = []
    for s in "ab":
        for d in pd.date_range("2020-01-10", periods=days):
            out.append((s, d.date(), None if rng.random() < gaps else round(float(rng.gamma(1, 5)), 3)))
    return out


def test_windows_against_pandas(spark):
    rows = station_rows()
    df = spark.createDataFrame(rows, "s string, t date, x double").repartition(5)
    w = win.by(["s"], "t")
    got = df.select("s", "t", win.lag("x", w, 2).alias("lag"), win.diff("x", w).alias("diff"), win.past_mean(F.col("x"), w).alias("mean"), win.past_sum(F.col("x"), w).alias("sum"), win.carried("x", w, 2).alias("ffill"), win.carried_both("x", w).alias("both"), win.past_median_window("x", ["s"], "t").alias("median")).toPandas().sort_values(["s", "t"])
    p = pd.DataFrame(rows, columns=["s", "t", "x"]).astype({"x": float})
    g = p.groupby("s")["x"]
    want = {
        "lag": g.shift(2), "diff": g.diff(), "mean": g.transform(lambda v: v.shift(1).rolling(3, min_periods=1).mean()), "sum": g.transform(lambda v: v.shift(1).rolling(3, min_periods=1).sum()),
        "ffill": g.ffill(limit=2), "both": g.transform(lambda v: v.ffill().bfill()), "median": g.transform(lambda v: v.shift(1).expanding(min_periods=1).median()),
    }
    for c, v in want.items():
        np.testing.assert_allclose(got[c].to_numpy(float), v.to_numpy(float), rtol=1e-12, err_msg=c)


def test_past_medians_agree_and_see_no_future(spark):
    rows = station_rows(5)
    df = spark.createDataFrame(rows, "s string, t date, x double")
    both = impute.past_proxy(df, "x", "s", F.month("t"), "t", "p").join(impute.past_proxy(df, "x", "s", F.month("t"), "t", "q", window=True).select("s", "t", "q"), ["s", "t"])
    assert both.where("not (p <=> q)").count() == 0
    assert both.where("(x is null) <> (p is not null)").count() == 0
    early = df.where("t < date'2020-02-01'")
    cut = impute.past_proxy(early, "x", "s", F.month("t"), "t", "p")
    assert sorted(map(repr, cut.collect())) == sorted(map(repr, impute.past_proxy(df, "x", "s", F.month("t"), "t", "p").where("t < date'2020-02-01'").collect()))


def test_cascade_leaves_no_null(spark):
    df = spark.createDataFrame([("a", pd.Timestamp("2020-01-01").date(), 4.0), ("a", pd.Timestamp("2020-01-02").date(), None), ("b", pd.Timestamp("2020-01-01").date(), None)], "s string, t date, v double")
    got = impute.cascade(df, "v", "s", F.month("t"), "t").orderBy("s", "t").collect()
    assert [r.v for r in got] == [4.0, 4.0, 4.0]


def test_dense_frame(spark):
    df = spark.createDataFrame(station_rows(), "s string, t date, x double").where("x is not null")
    full = frame.dense(df, "s", "t", "2020-01-01", "2020-03-01")
    assert full.count() == 2 * 61 == full.select("s", "t").distinct().count()
    assert full.agg(F.sum("x")).first()[0] == pytest.approx(df.agg(F.sum("x")).first()[0])


def test_daily_has_empty_days_and_first_values(spark):
    rows = [(1.0, "2020-01-01 00:00:00", 2.0, None), (1.0, "2020-01-01 06:00:00", 4.0, 0.5), (1.0, "2020-01-03 00:00:00", 1.0, 0.25)]
    df = spark.createDataFrame(rows, "cell double, t string, v double, m double").withColumn("time", F.to_timestamp_ntz("t")).withColumn("v", F.col("v").cast("float"))
    got = frame.daily(df, ["cell"], "time", ["v"], ["m"]).orderBy("time").collect()
    assert [(r.v, r.m) for r in got] == [(3.0, 0.5), (None, None), (1.0, 0.25)]


def test_levels_need_every_level(spark):
    df = spark.createDataFrame([(1, 500, 5.0), (1, 850, 8.0), (2, 500, 5.0), (3, 850, None), (3, 500, 1.0)], "k int, level int, z double")
    got = {r.k: (r.z_500, r.z_850) for r in frame.levels_wide(df, ["k"], "level", [500, 850], ["z"]).collect()}
    assert got == {1: (5.0, 8.0), 3: (1.0, None)}


def test_metrics_and_their_edges(spark):
    rng = np.random.default_rng(0)
    y, p = rng.gamma(1, 3, 200), rng.gamma(1, 3, 200)
    m = metrics.regression(spark.createDataFrame([*zip(y.tolist(), p.tolist()), (None, 1.0), (1.0, None)], "y double, p double"), "y", "p").first()
    e = p - y
    assert m.n == 200
    np.testing.assert_allclose([m.mae, m.rmse, m.wape_percent, m.r2, m.bias], [abs(e).mean(), math.sqrt((e**2).mean()), 100 * abs(e).sum() / abs(y).sum(), 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum(), e.mean()])
    zero = metrics.regression(spark.createDataFrame([(0.0, 1.0), (0.0, 2.0)], "y double, p double"), "y", "p").first()
    assert zero.wape_percent is None and zero.r2 is None
    single = metrics.regression_clipped(spark.createDataFrame([(1.0, -5.0), (float("inf"), 1.0)], "y double, p double"), "y", "p").first()
    assert (single.n, single.mae, single.r2) == (1, 1.0, None)


def test_rank_measures_against_pandas(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"a": rng.integers(0, 9, 300) * 1.0, "b": rng.integers(0, 50, 300) * 1.0, "c": rng.normal(size=300)})
    p.loc[rng.random(300) < 0.2, "a"] = None
    p.loc[rng.random(300) < 0.2, "b"] = None
    df = spark.createDataFrame([tuple(None if pd.isna(x) else float(x) for x in r) for r in p.to_numpy()], "a double, b double, c double")
    pearson, ranks = p.corr(), {(a, b): p[[a, b]].dropna().rank().corr().iloc[0, 1] for a, b in (("a", "b"), ("a", "c"), ("b", "c"))}
    for r in stats.pearson_pairs(df, ["a", "b", "c"]).collect():
        assert r.r == pytest.approx(pearson.loc[r.a, r.b])
    for r in stats.spearman_pairs(df, ["a", "b", "c"]).collect():
        assert r.r == pytest.approx(ranks[r.a, r.b])
    label, score = rng.integers(0, 2, 200), rng.integers(0, 12, 200)
    judged = spark.createDataFrame([(int(y), float(s)) for y, s in zip(label, score)], "y int, s double")
    wins = np.mean([(a > b) + (a == b) / 2 for a in score[label == 1] for b in score[label == 0]])
    assert stats.roc_auc(judged, "y", "s").first()[0] == pytest.approx(wins)


def test_expectations(spark):
    df = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "x double")
    assert {r.rule: r.violations for r in validate.violations(df, {"known": F.col("x").isNotNull(), "positive": F.col("x") > 0}).collect()} == {"known": 1, "positive": 2}
    with pytest.raises(validate.Violation, match="known: 1"):
        validate.check(df, {"known": F.col("x").isNotNull()})
    with pytest.raises(validate.Violation):
        validate.not_empty(a=df.limit(0))
    days = spark.createDataFrame([("2022-12-31",), ("2023-01-01",), ("2024-01-01",)], "t string").withColumn("t", F.to_date("t"))
    assert [p.count() for p in validate.split_by_time(days, "t")] == [1, 1, 1]


def test_column_choices(spark):
    df = spark.createDataFrame([("a", 1, 2.0)], ["STATION ", "b", "u_850_lag_1"])
    df = cols.trimmed(df)
    assert df.columns[0] == "STATION" and cols.first_of(df, ["site", "station"]) == "STATION"
    assert cols.numeric_columns(df, ["b"]) == ["u_850_lag_1"]
    assert cols.chosen(df, ["b", "x"], least=2) == (["b", "u_850_lag_1"], ["x"])
    want = {"u_850_lag_1": "era5_pressure_850hpa", "TEMP_lag_1": "lag_rolling", "moisture_flux_850": "era5_pressure_850hpa", "dv_850_500": "era5_pressure_500hpa", "TEMP": "gsod_surface", "PRCP": "target_or_auxiliary"}
    want |= {"LATITUDE": "location", "u10": "era5_single_level", "STATION": "metadata_time", "Year": "eda_helper", "day_sin": "temporal_cyclical", "dew_point_depression": "thermodynamic", "elevation_diff": "geometric", "abc": "other_engineered"}
    assert {c: cols.feature_group(c) for c in want} == want
    assert cols.selection_faults(df, ["b", "b", "STATION", "x"], 3, ["b"]) == {"count": ["4"], "repeated": ["b"], "leaks": ["b"], "absent": ["x"], "not_numeric": ["STATION"]}


def test_rank_correlation_with_nulls_and_ties(spark):
    rng = np.random.default_rng(2)
    rows = [tuple(None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 6, 2)) + (float(rng.integers(0, 3)), 1.0) for _ in range(200)]
    df = spark.createDataFrame(rows, "a double, b double, c double, same double")
    got = {(r.a, r.b): r.r for r in stats.spearman_pairs(df, ["a", "b", "c", "same"]).collect()}
    frame = pd.DataFrame(rows, columns=["a", "b", "c", "same"])
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        both = frame[[x, y]].dropna().rank()
        assert math.isclose(got[x, y], both[x].corr(both[y]), abs_tol=1e-9)
    assert got["a", "same"] is None or math.isnan(got["a", "same"])


def test_models_fall_back_and_explain(spark):
    rng = np.random.default_rng(5)
    rows = [(float(x), None if i % 9 == 0 else float(y), float(max(0, x))) for i, (x, y) in enumerate(rng.normal(size=(160, 2)))]
    df = features.targets(spark.createDataFrame(rows, "u double, v double, PRCP double"))
    small = replace(boosting.EVALUATION, rounds=2, leaves=4)
    few = models.two_stage(df.where("PRCP = 0 or u > 1.8"), ["u", "v"], settings=small, fallback=True)
    full = models.two_stage(df, ["u", "v"], settings=small, valid=df)
    assert few.amount is None and full.amount is not None
    for m in (few, full):
        assert m.predict(df).where("prediction is null or prediction < 0").count() == 0
    scores = models.combined(models.importances(df, ["u", "v"], settings=small), spark.createDataFrame([("u", 0.8, 0.4)], "feature string, abs_spearman double, abs_spearman_rain double"))
    assert {r.feature: r.score for r in scores.collect()}["u"] == pytest.approx(1.0)
    assert math.isclose(models.medians(df, ["v"])["v"], np.median([r[1] for r in rows if r[1] is not None]))
    assert [r.n_features for r in models.quick_check(df, df, ["u", "v"], ["u"], settings=small).collect()] == [2, 1]


def test_gates(spark):
    single, pressure = grids(spark)
    assert medallion.pressure_daily(pressure).where("latitude > 24").count() == 0 < medallion.pressure_daily(pressure).count()
    bad = single.withColumn("time", F.when(F.col("latitude") < 15, F.col("time")))
    with pytest.raises(validate.Violation, match="single_time"):
        medallion.gold(bronze(spark), bad, pressure, "2020-01-01", "2020-01-12")
    assert medallion.gold(bronze(spark), single, pressure, "2020-01-01", "2020-01-12").count() == 24


def test_pruning_and_scores(spark):
    assert selection.pruned(["a", "b", "c", "d"], {("a", "b"): -0.96, ("a", "c"): 0.5, ("c", "d"): 0.9}, most=3) == ["a", "c", "d"]
    parts = spark.createDataFrame([("a", 2.0, None), ("b", 1.0, -1.0)], "f string, p double, q double")
    assert {r.f: r.score for r in selection.scored(parts, "f", {"p": 0.5, "q": 0.5}).collect()} == {"a": 0.5, "b": 0.25}


def test_histogram_holds_everything(spark):
    df = spark.createDataFrame([(float(x),) for x in range(11)], "x double")
    h = eda.histogram(df, "x", 5).orderBy("bin").collect()
    assert [r["count"] for r in h] == np.histogram(range(11), 5)[0].tolist()
    flat = eda.histogram(spark.createDataFrame([(1.0,), (1.0,)], "x double"), "x", 3)
    assert sum(r["count"] for r in flat.collect()) == 2


def grids(spark):
    times = [f"2020-01-{d:02d} {h:02d}:00:00" for d in range(1, 13) for h in (0, 6, 12, 18)]
    cells = [(10.0, 105.0), (10.25, 105.0), (21.0, 105.75), (30.0, 105.0)]
    single = [(t, a, o, 300.0 + i % 5, 295.0, 300.0, 3.0, 4.0, 100000.0, 101000.0, 98.0665, 1.0) for i, t in enumerate(times) for a, o in cells]
    pressure = [(t, a, o, p, 57000.0 if p == 500 else 15000.0, 260.0 if p == 500 else 290.0, 0.001, 2.0, 1.0, -0.1) for t in times for a, o in cells for p in (500, 850)]
    make = lambda rows, s: spark.createDataFrame(rows, s.replace("timestamp_ntz", "string")).withColumn("time", F.to_timestamp_ntz("time"))
    return make(single, schemas.SINGLE_GRID), make(pressure, schemas.PRESSURE_GRID)


def bronze(spark):
    row = lambda s, d, temp="68.0", prcp="1.0", stp="1000.0", visib="6.0": (s, d, 10.1, 105.05, 5.0, temp, "50.0", prcp, "999.9", stp, "9999.9", visib, "name", 2020, "u")
    rows = [row("s1", f"2020-01-{d:02d}") for d in (1, 2, 3, 7, 8, 12)] + [row("s1", "2020-01-02", temp="9999.9"), row("s1", "bad day"), row(None, "2020-01-01"), row("s2", "2020-01-01", prcp="99.99", stp="12.3", visib="999.9")]
    return spark.createDataFrame(rows, schemas.BRONZE)


def test_medallion(spark):
    single, pressure = grids(spark)
    silver = medallion.silver(bronze(spark), medallion.single_daily(single), medallion.pressure_daily(pressure), "2020-01-01", "2020-01-12").cache()
    assert silver.count() == 24 == silver.select("STATION", "time").distinct().count()
    assert len(silver.columns) == 28 and not set(medallion.SUPPORT) & set(silver.columns)
    first = silver.where("STATION = 's1' and time = date'2020-01-01'").first()
    assert (first.TEMP, first.PRCP, first.WDSP, first.z) == (20.0, 25.4, 5.0, 10.0)
    assert silver.where("STATION = 's2' and PRCP is not null").count() == 0
    assert silver.where("VISIB is null or STP is null or SLP is null").count() == 0
    assert silver.where("STATION = 's1' and PRCP is not null").count() == 6
    gold = features.gold(silver).cache()
    assert len(gold.columns) == 77 and gold.count() == 24
    assert gold.where("PRCP is null and PRCP_impute is null").count() == 0
    validate.check(gold.where("PRCP is not null"), validate.gold_rules())
    assert validate.check_pressure_levels(gold) == []
    early = features.gold(silver.where("time < date'2020-01-07'"))
    same = gold.where("time < date'2020-01-07'")
    assert sorted(map(repr, early.select(*gold.columns).collect())) == sorted(map(repr, same.collect()))


def test_files_and_requests(spark, tmp_path):
    df = spark.createDataFrame([("a", "2020-01-01", 1.5), ("b", "2021-03-01", None)], "s string, t string, x double").withColumn("t", F.to_date("t"))
    files.write_csv(df, f"{tmp_path}/csv")
    back = files.read_csv(spark, f"{tmp_path}/csv", "s string, t date, x double")
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))
    files.write_yearly(df, f"{tmp_path}/year", "t", ["s"])
    assert sorted(p.name for p in (tmp_path / "year").glob("year=*")) == ["year=2020", "year=2021"]
    assert files.first_existing(spark, [f"{tmp_path}/none", f"{tmp_path}/year"]).endswith("year")
    files.write_report(df, f"{tmp_path}/r.csv")
    assert (tmp_path / "r.csv").read_bytes().startswith(b"\xef\xbb\xbf")
    files.write_metadata({"rows": 2}, f"{tmp_path}/m.json")
    files.write_text(["a", "b"], f"{tmp_path}/r.txt")
    assert json.loads((tmp_path / "m.json").read_text()) == {"rows": 2} and (tmp_path / "r.txt").read_text() == "a\nb\n"
    assert fetch.single_level_request(2020)["year"] == ["2020"] and fetch.pressure_level_request(2020)["pressure_level"] == ["500", "850"]
    asked = []
    retrieve = lambda y, path: (asked.append(y), open(path, "w").write("x"))
    for _ in range(2):
        assert len(fetch.land_yearly([2020, 2021], lambda y: f"{tmp_path}/{y}.grib", retrieve)) == 2
    assert asked == [2020, 2021]


def test_station_years(spark, tmp_path):
    (tmp_path / "2020").mkdir()
    (tmp_path / "2020" / "s1.csv").write_text("STATION,DATE,LATITUDE,LONGITUDE,ELEVATION,TEMP,PRCP\ns1,2020-01-01,10.0,105.0,,68.0, 0.10\n")
    df = fetch.station_years(spark, url=f"file://{tmp_path}/{{year}}/{{station}}.csv", stations="s1=One,s2=Two", first_year=2020, last_year=2021, pause=0)
    rows = df.collect()
    assert [(r.STATION, r.TEMP, r.PRCP, r.ELEVATION, r.station_name, r.source_year) for r in rows] == [("s1", "68.0", "0.10", None, "One", 2020)]


def test_joins(spark):
    a = spark.createDataFrame([(1, 2.0), (2, None)], "k int, x double")
    b = spark.createDataFrame([(2, 5.0), (3, 6.0)], "k int, y double")
    assert {r.k: (r.x, r.y) for r in joins.outer_filled(a, b, "k").collect()} == {1: (2.0, 0.0), 2: (0.0, 5.0), 3: (0.0, 6.0)}
    assert [r.k for r in joins.matching(a, b, ["k"]).collect()] == [2] and [r.k for r in joins.unmatched(a, b, ["k"]).collect()] == [1]


def test_stream_of_days(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = daily.read_events(spark, f"{tmp_path}/in", events.schema.simpleString()[7:-1].replace(":", " "), 1)
    daily.append_to(daily.daily_sums(stream, late="40 days"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    want = events.groupBy(F.col("user_id").alias("station"), F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    assert got.join(want, ["station", "day", "n"]).count() == got.count()


def test_feature_sets(spark):
    from pluvial.functions import feature_sets
    from pluvial.operators import report

    assert len(feature_sets.SELECTED) == 46 == len(set(feature_sets.SELECTED)) and len(feature_sets.SELECTED_DASHBOARD) == 54
    df = spark.createDataFrame([("s", 1.0, 2.0, 3.0)], ["STATION", "PRCP", "TEMP", "other"])
    assert feature_sets.full(df) == ["TEMP", "other"] and feature_sets.selected(df)[0] == ["TEMP"] and len(feature_sets.selected(df)[1]) == 45
    assert feature_sets.selected_dashboard(df) == ["TEMP", "other"]
    rows = [(fs, "test", m, 3, 1.25003 + i, 1.0, None, 0.5, 0.0) for i, fs in enumerate(("full", "selected")) for m in ("one_stage",)] + [("none", "test", "persistence", 0, 9.0, 1.0, 1.0, 0.1, 0.0)]
    results = spark.createDataFrame(rows, "feature_set string, scenario string, model string, n_features int, mae_mm double, rmse_mm double, wape_percent double, r2 double, bias_mean_pred_minus_true_mm double")
    both = report.compared(results).collect()
    assert [r.model for r in both] == ["one_stage"] and [both[0].mae_mm_full, both[0].mae_mm_selected] == pytest.approx([1.25003, 2.25003])
    assert report.printable(results).first().mae_mm == 1.25
    assert report.best(results).first().model == "one_stage"
