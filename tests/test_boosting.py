"""Boosted trees against a plain numpy version, reruns, stopping, importances."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvial.operators import boosting, metrics, models
from pluvial.operators.boosting import Settings

PLAIN = Settings(rounds=4, rate=0.2, leaves=6, least_rows=5, rows=1.0, columns=1.0, patience=0, bins=16)


def slopes(kind, f, y, w, power=1.3):
    if kind == "tweedie":
        return w * (np.exp((2 - power) * f) - y * np.exp((1 - power) * f)), w * ((2 - power) * np.exp((2 - power) * f) - (1 - power) * y * np.exp((1 - power) * f))
    if kind == "binary":
        p = 1 / (1 + np.exp(-f))
        return w * (p - y), w * p * (1 - p)
    return w * (f - y), w


def losses(kind, f, y, power=1.3):
    if kind == "tweedie":
        return np.mean(np.exp((2 - power) * f) / (2 - power) - y * np.exp((1 - power) * f) / (1 - power))
    return np.mean(np.log1p(np.exp(f)) - y * f) if kind == "binary" else np.mean((f - y) ** 2)


def brute_tree(x, g, h, s):
    """Best-first growth by trying every threshold on the rows of every leaf."""

    def worth(rows):
        t = max(abs(g[rows].sum()) - s.l1, 0)
        return t * t / (h[rows].sum() + s.l2)

    def split(rows):
        best = None
        for c in range(x.shape[1]):
            for b in range(1, s.bins):
                for miss in (False, True):
                    go = np.where(x[rows, c] == 0, miss, x[rows, c] <= b)
                    left, right = rows[go], rows[~go]
                    if min(len(left), len(right)) >= s.least_rows and min(h[left].sum(), h[right].sum()) >= s.least_weight:
                        gain = worth(left) + worth(right) - worth(rows)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9 * abs(best[0])):
                            best = (gain, c, b, left, right)
        return best

    leaves = [(np.arange(len(x)), split(np.arange(len(x))))]
    while len(leaves) < s.leaves:
        i = max(range(len(leaves)), key=lambda i: leaves[i][1][0] if leaves[i][1] else 0)
        if not leaves[i][1]:
            break
        _, (_, _, _, left, right) = leaves.pop(i)
        leaves += [(left, split(left)), (right, split(right))]
    out = np.zeros(len(x))
    for rows, _ in leaves:
        total = g[rows].sum()
        out[rows] = -s.rate * np.sign(total) * max(abs(total) - s.l1, 0) / (h[rows].sum() + s.l2)
    return out, len(leaves)


def data(n=300, seed=1):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 5, n).astype(float), rng.exponential(size=n)
    mean = np.exp(0.8 * (a > 0.2) * b / 2 + 0.3 * c - 1)
    y = np.round(np.where(rng.random(n) < 0.4, 0.0, rng.gamma(2, mean / 2)), 3)
    a[rng.random(n) < 0.15] = np.nan
    return np.stack([a, b, c], axis=1), y


def frame(spark, v, y, parts=3):
    rows = [(i, *[None if math.isnan(t) else float(t) for t in r], float(t)) for i, (r, t) in enumerate(zip(v, y, strict=True))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double").repartition(parts)


@pytest.mark.parametrize("kind", ["tweedie", "binary", "squared"])
def test_trees_equal_a_plain_version(spark, monkeypatch, kind):
    monkeypatch.setattr(boosting, "KEEP", 2)
    v, y = data()
    if kind == "binary":
        y = (y > 0.5).astype(float)
    s = replace(PLAIN, objective=kind)
    df = frame(spark, v, y)
    model = boosting.fit(df, ["a", "b", "c"], "y", s, balanced=kind == "binary")
    x = model.bins(v)
    w = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y == 0).sum())) if kind == "binary" else np.ones(len(y))
    f = np.full(len(y), math.log(y.mean()) if kind == "tweedie" else 0.0 if kind == "binary" else y.mean())
    for t in range(s.rounds):
        step, leaves = brute_tree(x, *slopes(kind, f, y, w), s)
        assert leaves == model.trees[t].left.count(-1) <= s.leaves
        assert np.allclose(model.trees[t].values_of(x), step, atol=1e-7)
        f += step
    want = {"tweedie": np.exp(f), "binary": 1 / (1 + np.exp(-f)), "squared": f}[kind]
    got = {r.id: r.prediction for r in model.predict(df).collect()}
    assert np.allclose([got[i] for i in range(len(y))], want, atol=1e-6)


@pytest.mark.parametrize("kind", ["tweedie", "squared"])
def test_stops_at_the_round_of_the_plain_version(spark, kind):
    v, y = data(160, 2)
    u, z = data(90, 3)
    s = replace(PLAIN, objective=kind, rounds=40, rate=0.6, patience=3)
    model = boosting.fit(frame(spark, v, y), ["a", "b", "c"], "y", s, frame(spark, u, z))
    x, xv = model.bins(v), model.bins(u)
    f = np.full(len(y), math.log(y.mean()) if kind == "tweedie" else y.mean())
    fv = np.full(len(z), f[0])
    history = [losses(kind, fv, z)]
    while len(history) < s.rounds + 1 and len(history) - 1 - int(np.argmin(history)) < s.patience:
        step, _ = brute_tree(x, *slopes(kind, f, y, np.ones(len(y))), s)
        f += step
        # the plain tree's values for validation rows: those of training rows in the same leaf of the fitted tree
        k = len(history) - 1
        fv += model.trees[k].values_of(xv) if k < model.best else 0
        if k >= model.best:
            break
        assert np.allclose(model.trees[k].values_of(x), step, atol=1e-7)
        history.append(losses(kind, fv, z))
    assert np.allclose(model.history[: len(history)], history, atol=1e-4)
    assert model.best == int(np.argmin(model.history)) < s.rounds
    assert len(model.history) - 1 == model.best + s.patience


def test_other_partitions_give_the_same_trees(spark):
    v, y = data(400, 4)
    s = replace(PLAIN, rows=0.7, columns=0.67, rounds=4, measure="rmse", patience=9)
    valid = frame(spark, *data(60, 5), 2)
    fits = [boosting.fit(frame(spark, v, y, p), ["a", "b", "c"], "y", s, valid.repartition(p)) for p in (1, 5)]
    assert fits[0].trees == fits[1].trees and fits[0].history == fits[1].history
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for t in fits[0].trees)
    kept = [int(boosting.sampled(np.arange(20000) * 7919, t, 42, 0.7).sum()) for t in range(2)]
    assert all(abs(k - 14000) < 400 for k in kept)
    assert not (boosting.sampled(np.arange(1000), 0, 42, 0.7) == boosting.sampled(np.arange(1000), 1, 42, 0.7)).all()


def test_importances_recounted_from_the_trees(spark):
    v, y = data(300, 6)
    df = frame(spark, v, y)
    model = boosting.fit(df, ["a", "b", "c"], "y", PLAIN)
    got = {r.feature: (r.importance, r.importance_gain) for r in model.importances(spark).collect()}
    for i, name in enumerate(model.features):
        mine = [(t.gain[j]) for t in model.trees for j in range(len(t.left)) if t.left[j] >= 0 and t.feature[j] == i]
        assert got[name][0] == len(mine) and math.isclose(got[name][1], sum(mine), abs_tol=1e-9)
    table = model.nodes(spark)
    leaves = table.where("feature is null").groupBy("tree").agg(F.sum("rows").alias("n")).collect()
    assert all(r.n == 300 for r in leaves)
    assert table.where("feature is not null and gain <= 0").count() == 0


def test_deviance_falls_below_the_linear_model(spark):
    v, y = data(600, 7)
    df = frame(spark, v, y)
    trees = models.one_stage(df, ["a", "b", "c"], "y", settings=replace(PLAIN, rounds=12))
    line = models.tweedie(df, ["a", "b", "c"], "y")
    loss = lambda d: d.agg(F.avg(F.pow("prediction", 0.7) / 0.7 + F.col("y") * F.pow("prediction", -0.3) / 0.3)).first()[0]
    assert loss(trees.predict(df)) < loss(line(df))


def test_two_stage_and_fallback(spark):
    v, y = data(240, 8)
    df = frame(spark, v, y).withColumns({"rain": (F.col("y") >= 0.1).cast("int"), "log": F.log1p("y")})
    small = replace(PLAIN, rounds=3, patience=2)
    full = models.two_stage(df, ["a", "b", "c"], "rain", "log", small, df.where("id % 3 = 0"))
    assert full.amount is not None and full.predict(df).where("prediction is null or prediction < 0").count() == 0
    few = models.two_stage(df.where("rain = 0 or id < 20"), ["a"], "rain", "log", small, fallback=True)
    assert few.amount is None and few.mean > 0
    with pytest.raises(ValueError, match="no rainy"):
        models.two_stage(df.where("rain = 0"), ["a"], "rain", "log", replace(small, rounds=1))
    with pytest.raises(ValueError, match="no training"):
        boosting.fit(df.limit(0), ["a"], "y", small)
    constant = boosting.fit(df.withColumn("same", F.lit(1.0)), ["same"], "y", small)
    assert metrics.regression(constant.predict(df.withColumn("same", F.lit(1.0))), "y", "prediction").first().n == 240
