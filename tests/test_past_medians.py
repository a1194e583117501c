"""Medians of earlier values against numpy, and how many rows they take."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvial.operators import past_medians, store
from pluvial.operators import windows as win


def rows(seed, sizes=(700, 40, 3, 1)):
    rng = np.random.default_rng(seed)
    day = datetime.date(2020, 1, 1)
    for k, n in enumerate(sizes):
        drift = np.cumsum(rng.normal(size=n))
        v = [None, lambda i: float(rng.integers(0, 3)), lambda i: float(drift[i]), lambda i: 0.0 if rng.random() < 0.8 else float(rng.exponential())][1 + k % 3]
        gap_days = np.cumsum(rng.integers(1, 4, n))
        for i in range(n):
            yield (k, day + datetime.timedelta(int(gap_days[i])), None if rng.random() < 0.2 else v(i), int(rng.integers(0, 3)))
    yield (None, day, None, 0)
    yield (9, day, float("nan"), 0)
    yield (9, day + datetime.timedelta(1), None, None)


@pytest.mark.parametrize(("least", "buckets"), [(1024, 1024), (16, 8), (5, 40), (1, 3)])
def test_medians_equal_numpy(spark, monkeypatch, least, buckets):
    monkeypatch.setattr(past_medians, "LEAST", least)
    monkeypatch.setattr(past_medians, "BUCKETS", buckets)
    data = list(rows(least))
    df = spark.createDataFrame(data, "k int, t date, v double, s int").repartition(3)
    got = {(r.k, r.t): r for r in win.with_past_medians(df, "v", ["k"], "t", {"every": [], "season": ["s"]}).collect()}
    assert len(got) == len(data)
    for k, t, v, s in data:
        past = [(x, z) for kk, u, x, z in data if kk == k and k is not None and u < t and x is not None and not np.isnan(x)]
        every, season = [x for x, _ in past], [x for x, z in past if z == s and s is not None]
        for name, own in (("every", every), ("season", season)):
            want = float(np.median(own)) if own and v is None else None
            assert getattr(got[k, t], name) == (want if want is None else pytest.approx(want, abs=1e-12))


def test_rows_where_and_other_orders(spark, monkeypatch):
    df = spark.createDataFrame([("a", i, float(i % 4)) for i in range(30)], "k string, t long, v double")
    got = win.with_past_median(df, "v", ["k"], "t", "m", F.col("t") % 7 == 0).collect()
    assert {r.t: r.m for r in got} == {i: (float(np.median([j % 4 for j in range(i)])) if i % 7 == 0 and i else None) for i in range(30)}
    for least in (1024, 4):
        monkeypatch.setattr(past_medians, "LEAST", least)
        text = df.withColumn("t", F.format_string("%03d", "t"))
        assert {int(r.t): r.m for r in win.with_past_median(text, "v", ["k"], "t", "m", F.col("t") == "029").collect()}[29] == 1.0


def test_fetched_rows_grow_with_one_keys_rows(spark, monkeypatch):
    """One station: twice the rows, about twice the work; every tenth row has a gap."""
    took = []
    for n in (100_000, 200_000):
        df = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("t"), F.when(F.col("id") % 10 != 0, F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double")).alias("v"))
        found = []
        fetched = past_medians._fetched

        def counted(*a, fetched=fetched, found=found):
            out, _ = store.written(fetched(*a), "fetched")
            found.append(out.count())
            return out

        monkeypatch.setattr(past_medians, "_fetched", counted)
        out = past_medians.medians(df, "v", ["k"], "t", {"m": []}, F.col("v").isNull())
        last = out.where(F.col("t") == n - 10).first().m
        monkeypatch.setattr(past_medians, "_fetched", fetched)
        assert last == df.where(F.col("t") < n - 10).agg(F.median("v")).first()[0]
        took.append(found[0])
    assert took[0] < 8 * 100_000 and took[1] < 2.6 * took[0]
    print("fetched", took)
