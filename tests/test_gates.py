"""Checks in the same job, publishing, ordered files, array cells and the codebook."""

import glob

import pytest
from pyspark.sql import functions as F

from pluvial.operators import frame, validate
from pluvial.plans import gates, medallion
from pluvial.sources import files
from tests.test_operators import bronze, grids


def executions(spark):
    return spark._jsparkSession.sharedState().statusStore().executionsCount()


def test_checks_are_counted_while_the_table_is_written(spark, tmp_path):
    audit = validate.Audit()
    df = audit.watch(spark.range(100), "ids", {"small": F.col("id") < 98, "known": F.col("id").isNotNull()}, {"small": 0.05}, {"has_7": F.col("id") == 7, "has_700": F.col("id") == 700})
    df = audit.watch(df.groupBy((F.col("id") % 3).alias("k")).count(), "groups", {"big": F.col("count") > 33})
    before = executions(spark)
    df.write.parquet(f"{tmp_path}/out")
    assert executions(spark) == before + 1
    assert audit.report() == [("ids_small", "WARNING", 2, 100), ("ids_known", "PASS", 0, 100), ("ids_has_7", "PASS", 0, 100), ("ids_has_700", "FAIL", 1, 100), ("groups_big", "FAIL", 2, 3)]
    assert executions(spark) == before + 1
    with pytest.raises(validate.Violation, match="groups_big: 2"):
        audit.settle()


def test_gold_runs_once(spark, monkeypatch):
    single, pressure = grids(spark)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pressure = pressure.mapInArrow(counted, pressure.schema)
    audit = validate.Audit()
    plan = medallion.watched_gold(bronze(spark), single, pressure, "2020-01-01", "2020-01-12", audit)
    already = seen.value
    plan.write.format("noop").mode("overwrite").save()
    once = seen.value - already
    assert once <= 2 * 384  # the daily means and their span, at most
    report = {check: (status, rows) for check, status, _, rows in audit.report()}
    assert report["single_time_is_read"] == ("PASS", 192) and report["pressure_level_850_is_there"][0] == "PASS" and report["gold_label_follows_rain"] == ("PASS", 24)
    with pytest.raises(validate.Violation, match="level_850"):
        medallion.gold(bronze(spark), single, grids(spark)[1].where("isobaricInhPa = 500"), "2020-01-01", "2020-01-12")


def test_readers_see_the_old_table_when_an_audit_fails(spark, tmp_path):
    root, rules = str(tmp_path), {"positive": F.col("id") > 0}
    with pytest.raises(FileNotFoundError):
        gates.published(spark, root, "t")
    gates.publish(spark.range(1, 5), root, "t", rules)
    old = gates.published(spark, root, "t")
    with pytest.raises(validate.Violation, match="t_positive: 1"):
        gates.publish(spark.range(0, 9), root, "t", rules)
    with pytest.raises(validate.Violation, match="0 rows"):
        gates.publish(spark.range(0), root, "t", rules)
    with pytest.raises(Exception, match="stop"):
        gates.publish(spark.range(3).select(F.raise_error(F.lit("stop")).alias("id")), root, "t")
    assert sorted(r.id for r in gates.published(spark, root, "t").collect()) == [1, 2, 3, 4]
    assert len(glob.glob(f"{root}/.tables/t-*")) == 1
    about = gates.publish(spark.range(5, 7), root, "t", rules)
    assert about["rows"] == 2 and old.count() == 4 and gates.published(spark, root, "t").count() == 2
    assert [tuple(r) for r in gates.report(spark, root, "t").collect()] == [("t_positive", "PASS", 0, 2)]
    gates.publish(spark.range(5, 8), root, "t", rules)
    assert len(glob.glob(f"{root}/.tables/t-*")) == 2  # the last and the one before
    plan = [("a", lambda: spark.range(4), [], {}), ("b", lambda a: a.where("id > 9"), ["a"], {}), ("c", lambda b: b, ["b"], {})]
    with pytest.raises(validate.Violation, match="b: 0 rows"):
        gates.steps(spark, root, plan)
    assert gates.published(spark, root, "a").count() == 4
    with pytest.raises(FileNotFoundError):
        gates.manifest(spark, root, "c")


def test_files_in_order_of_their_names(spark, tmp_path):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(700)).alias("k"), "id", F.lit("x").alias("row"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files.write_ordered(df, f"{tmp_path}/o", ["k", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(glob.glob(f"{tmp_path}/o/part-*"))
    assert len(parts) > 4
    rows = [tuple(r) for p in parts for r in spark.read.parquet(p).select("k", "id").collect()]
    assert rows == sorted(rows) and len(rows) == 5000
    numbered = files.read_numbered(spark, f"{tmp_path}/o", "n").select("n", "k", "id")
    assert [tuple(r)[1:] for r in sorted(numbered.collect())] == rows
    assert [r[0] for r in sorted(numbered.collect())] == list(range(1, 5001))
    assert "Sort " not in numbered._jdf.queryExecution().executedPlan().toString().split("Window")[0]
    assert [tuple(r)[:2] for r in files.preview(spark, f"{tmp_path}/o", 7).collect()] == rows[:7]
    files.write_ordered(df.limit(9), f"{tmp_path}/c", ["id"], "csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 9


def test_cells_of_arrays(spark):
    rows = [(1, [10.0, 20.0], [1, 2, 3], [[1.0, 2.0, 3.0], [4.0, None, 6.0]], [1, 2, 3, 4, 5, 6]), (2, [5.0], [7], None, [9]), (3, [], [7], [], []), (4, None, [7], None, None)]
    df = spark.createDataFrame(rows, "t int, lat array<double>, lon array<int>, v array<array<double>>, w array<int>")
    got = [tuple(r) for r in frame.array_rows(df, ["v", "w"], [("latitude", "lat"), ("longitude", "lon")]).collect()]
    want = [(1, a, o, [[1.0, 2.0, 3.0], [4.0, None, 6.0]][i][j], 3 * i + j + 1) for i, a in enumerate((10.0, 20.0)) for j, o in enumerate((1, 2, 3))]
    assert sorted(got, key=str) == sorted([*want, (2, 5.0, 7, None, 9)], key=str)
    with pytest.raises(Exception, match="not a value for each cell"):
        frame.array_rows(spark.createDataFrame([([1], [1, 2])], "a array<int>, v array<int>"), ["v"], [("x", "a")]).collect()


def test_codebook(spark):
    df = spark.createDataFrame([(1, 2.0, "x", None), (5, None, "y", None)], "a int, b double, c string, d double")
    book = spark.createDataFrame([("a", "int", 0.0, 4.0, None), ("b", "double", None, 2.0, 2), ("c", "double", None, None, None), ("e", "int", None, None, None)], "column string, type string, low double, high double, least_known bigint")
    assert {r.column: r.verdict for r in validate.against_codebook(df, book).collect()} == {"a": "out_of_range", "b": "too_few", "c": "mistyped", "d": "extra", "e": "absent"}
    assert {r.column: (r.known, r.least, r.greatest) for r in validate.profile(df).collect()}["a"] == (2, 1.0, 5.0)
