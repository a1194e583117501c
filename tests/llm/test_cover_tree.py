"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvial.llm import _vectors, cover_tree, queries
from tests.oracle import ordered, sql_rows


def brute(rows, anchors, positives=5, negatives=3, low=50, high=95, scale=256):
    rows = [(i, y, np.floor(scale * np.asarray(v, float)).astype(int)) for i, v, y in rows if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, label, q in rows:
        if not anchors(a):
            continue
        scored = sorted((-int(q @ v), i, y == label) for i, y, v in rows if i != a and len(v) == len(q))
        for p_score, p, _ in [s for s in scored if s[2]][:positives]:
            fits = [s for s in scored if not s[2] and low * -p_score <= 100 * -s[0] <= high * -p_score][:negatives]
            out += [(a, p, k, n, -p_score, -s) for k, (s, n, _) in enumerate(fits, 1)]
    return sorted(out)


def vectors(rng, n=400):
    centers = rng.standard_normal((6, 16))
    out = [(i, (centers[i % 6] * rng.uniform(0.2, 2) + 0.3 * rng.standard_normal(16)).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    hot = rng.standard_normal(16).tolist()
    out += [(n + i, hot, i % 3) for i in range(n // 2)]
    out += [(2 * n, None, 1), (2 * n + 1, [], 1), (2 * n + 2, [None] * 16, 1), (2 * n + 3, [float("nan")] * 16, 1), (2 * n + 4, hot, None), (None, hot, 1)]
    out += [(2 * n + 10, [0.0] * 16, 1), (2 * n + 20, [1.0, 2.0], 1), (2 * n + 21, [1.0, 1.5], 1), (2 * n + 22, [1.0, 0.5], 2), (2 * n + 30, [-9.0] * 16, 70), (2 * n + 31, [-8.0] * 16, 6), (2 * n + 32, [-7.0] * 16, 70)]
    return out + [out[10], out[11]]


@pytest.mark.parametrize(("members", "anchors", "wave"), [(2048, 256, 8), (7, 5, 1)])
def test_equals_brute_force(spark, monkeypatch, members, anchors, wave):
    for name, value in (("MEMBERS", members), ("ANCHORS", anchors), ("WAVE", wave)):
        monkeypatch.setattr(cover_tree, name, value)
    rows = vectors(np.random.default_rng(3))
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], "vec_id long, embedding array<double>, label int, v int, ids int").repartition(3)
    got = cover_tree.mine(df, lambda i: i % 10 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows, lambda i: i % 10 == 0)
    assert cover_tree.mine(df.limit(0), lambda i: i % 10 == 0).count() == 0


def test_tree_covers_level_by_level():
    rng = np.random.default_rng(5)
    z = rng.integers(-300, 300, (500, 8))
    z[100:200] = z[0]
    nodes, m = cover_tree.build(z, rng.integers(0, 9, 500))
    unit = np.concatenate([z, np.sqrt(np.maximum(m * m - (z * z).sum(1), 0))[:, None]], axis=1) / m
    seen = []

    def members(at):
        r = nodes[at]
        out = {int(r["center"])}
        for c in range(r["first"], r["first"] + r["children"]):
            assert nodes["level"][c] == r["level"] + 1
            assert r["angle"] <= 2e-6 or nodes["angle"][c] <= r["angle"] / 2 + 1e-5
            out |= members(c)
        assert max(np.arccos(np.clip(unit[list(out)] @ unit[r["center"]], -1, 1))) <= r["angle"] + 1e-6
        seen.append(at)
        return out

    assert members(0) == set(range(500)) and len(seen) == len(nodes)


def test_bounds_skip_what_lies_outside():
    """In clustered vectors most products are spared; the share is stated in the README."""
    rng = np.random.default_rng(6)
    centers = rng.standard_normal((40, 64))
    z = np.floor(256 * (centers[rng.integers(0, 40, 2048)] + 0.1 * rng.standard_normal((2048, 64)))).astype(np.int64)
    labels, ids = rng.integers(0, 5, 2048), np.arange(2048)
    nodes, m = cover_tree.build(z, labels)
    search, best = cover_tree.Search(5, same=True), _vectors.Best(100, 5, np.int64)
    every = np.full(100, cover_tree.LOWEST), np.full(100, cover_tree.HIGHEST)
    search.meet(best, z[:100], ids[:100], labels[:100], *every, z, ids, labels, nodes, m)
    assert search.multiplied < 0.3 * 100 * 2048
    scores = z[:100] @ z.T
    for i in range(100):
        want = sorted((-scores[i, j], j) for j in range(2048) if j != i and labels[j] == labels[i])[:5]
        own = best.query == i
        assert list(zip((-best.scores[own]).tolist(), best.ids[own].tolist(), strict=True)) == [(int(s), j) for s, j in want]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_rows_equal_sql(spark, sf):
    df = queries.op11_cover_tree(spark, sf)
    assert df.select(F.count_distinct("anchor_id")).first()[0] == 10
    assert ordered(df.columns, [tuple(r) for r in df.collect()]) == ordered(*sql_rows(cover_tree.SQL, sf))
