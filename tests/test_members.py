"""Several grid rows of one time, cell and level: members of an ensemble, users of one cell in the stand-in."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pluvial.operators import frame
from pluvial.plans import medallion, queries

from .oracle import ordered, sql_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def shared(spark, tmp_path_factory):
    """The events of sf0.001, and again by users of the same cells with other values."""
    root = str(tmp_path_factory.mktemp("shared"))
    events = queries.table(spark, SF, "events")
    again = events.withColumns({"user_id": F.col("user_id") + 1830, "event_id": F.col("event_id") + 10**6, "value": F.col("value") * 0.75 + 1})
    events.unionByName(again).coalesce(1).write.parquet(f"{root}/part")
    (part,) = Path(f"{root}/part").glob("*.parquet")
    shutil.move(part, f"{root}/events.parquet")
    return root


def test_gold_of_shared_cells_equals_sql(spark, shared):
    df = queries.gold_table(spark, shared)
    columns, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    assert (columns, rows) == ordered(*sql_rows(queries.SQL["gold_table"], shared))


def test_silver_of_shared_cells_equals_sql(spark, shared):
    """But for ``lsm``, where the SQL takes any of the users whose six hours come first."""
    df = queries.silver_table(spark, shared).drop("lsm")
    columns, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    want_columns, want = sql_rows(queries.SQL["silver_table"], shared)
    at = want_columns.index("lsm")
    assert (columns, rows) == ordered([c for c in want_columns if c != "lsm"], [r[:at] + r[at + 1 :] for r in want])


def test_members_meet_their_own_levels(spark):
    rows = [(n, p, float(p + 10 * n)) for n in (1, 2, 3) for p in (500, 850) if (n, p) != (3, 850)]
    df = spark.createDataFrame(rows, "number int, isobaricInhPa int, x double")
    grid = df.select(F.lit("2020-01-01 06:00:00").cast("timestamp_ntz").alias("time"), F.lit(10.0).cast("float").alias("latitude"), F.lit(105.0).cast("float").alias("longitude"), "isobaricInhPa", "number", *[F.col("x").cast("float").alias(c) for c in "ztquvw"])
    (r,) = medallion.pressure_daily(grid).collect()
    assert (r.q_500, r.q_850) == (515.0, 865.0)  # without member 3, whose lower level is absent
    (r,) = medallion.pressure_daily(grid.drop("number")).collect()
    assert (r.q_500, r.q_850) == (520.0, 865.0)


def test_first_of_equal_times_is_the_least(spark):
    df = spark.createDataFrame([(1, 2, 0.5), (1, 1, 0.75), (1, 1, 0.25), (1, 1, None), (1, 0, None)], "k int, t int, x double")
    for order in ("x", F.desc("x")):
        assert df.orderBy(order).coalesce(1).groupBy("k").agg(frame.first_valid("x", "t").alias("x")).first().x == 0.25
