"""Exact ranks and percentiles against numpy, with brackets narrowed many times."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvial.operators import order_stats

P = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def columns(n=3000):
    rng = np.random.default_rng(1)
    yield "normal", rng.normal(size=n)
    yield "tied", rng.integers(0, 4, n).astype(float)
    yield "mostly_zero", np.where(rng.random(n) < 0.9, 0.0, rng.exponential(size=n))
    yield "wild", rng.choice([-1e300, -1.0, 0.0, 1e-300, 1e300], n) * rng.random(n)
    yield "same", np.full(n, 7.5)
    yield "few_known", np.where(np.arange(n) < n - 3, np.nan, np.arange(n))
    yield "none", np.full(n, np.nan)


@pytest.mark.parametrize(("block", "accuracy", "at_once"), [(200_000, 5000, 40), (10, 20, 3), (1, 50, 100)])
def test_percentiles_equal_numpy(spark, monkeypatch, block, accuracy, at_once):
    for name, value in (("BLOCK", block), ("ACCURACY", accuracy), ("AT_ONCE", at_once)):
        monkeypatch.setattr(order_stats, name, value)
    data = dict(columns())
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in zip(*data.values(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in data)).repartition(5)
    got = order_stats.percentiles(df, {c: (F.col(c), P) for c in data})
    for c, v in data.items():
        known = v[~np.isnan(v)]
        assert got[c] == [None] * len(P) if not len(known) else np.allclose(got[c], np.percentile(known, np.array(P) * 100), rtol=1e-12), c


def test_ranks_of_nothing(spark):
    assert order_stats.percentiles(spark.createDataFrame([], "x double"), {"x": (F.col("x"), [0.5])}) == {"x": [None]}


def test_last_step_holds_a_block_at_most(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "BLOCK", 50)
    monkeypatch.setattr(order_stats, "ACCURACY", 100)
    held = []
    finish = order_stats._finish
    monkeypatch.setattr(order_stats, "_finish", lambda rows, own, part: (held.extend(r.within for r in part), finish(rows, own, part)))
    df = spark.range(100_000).select(F.xxhash64("id").cast("double").alias("x"))
    assert order_stats.percentiles(df, {"x": (F.col("x"), [0.3, 0.7])})["x"] == df.agg(F.percentile("x", F.array(F.lit(0.3), F.lit(0.7)))).first()[0]
    assert held and max(held) <= 50
