"""Boosting's blocks of rows and exact sums, and inputs that are computed once."""

from dataclasses import replace

import numpy as np
import pytest

from pluvial.operators import boosting, store
from pluvial.plans import queries

from .test_boosting import PLAIN, data, frame

SF = "/root/testdata/sf0.001"


@pytest.fixture
def writes(monkeypatch):
    """What goes to the shared folder, by kind: rows of the table."""
    found, real = [], store.written

    def kept(df, kind, *options):
        out = real(df, kind, *options)
        found.append((kind, out[0].count(), out[0].select("n", "valid").collect() if "loss" in out[0].columns else None))
        return out

    monkeypatch.setattr(store, "written", kept)
    return found


def test_rows_lie_in_blocks(spark, writes):
    v, y = data(900, 9)
    valid = frame(spark, *data(70, 10), 1)
    model = boosting.fit(frame(spark, v, y, 2), ["a", "b", "c"], "y", replace(PLAIN, rounds=2, patience=9), valid)
    assert len(model.history) == 3
    for _, blocks, rows in writes:
        assert blocks <= 6
        assert (sum(r.n for r in rows if not r.valid), sum(r.n for r in rows if r.valid)) == (900, 70)
    assert [kind for kind, *_ in writes] == ["bins", "scores", "scores"]


def test_sums_by_cell_are_exact():
    rng = np.random.default_rng(1)
    for top in (1 << 20, 1 << 52):
        v, cell = rng.integers(-top, top, 5000), rng.integers(0, 7, 5000)
        sums = np.zeros((9, 3), np.int64)
        boosting._added(sums, cell, [(0, boosting._pieces(v)), (1, boosting._pieces(np.abs(v)))])
        want = [(sum(int(x) for x in v[cell == c]), sum(abs(int(x)) for x in v[cell == c]), int((cell == c).sum())) for c in range(9)]
        assert [tuple(map(int, r)) for r in sums] == want


def test_lines_are_joined_once(spark):
    plan = queries.priced(spark, SF)._jdf.queryExecution().toString()
    assert "Join" not in plan and "lineitem" not in plan


def test_frame_is_computed_once(spark, writes, monkeypatch):
    real, calls = queries.targets_frame, []
    monkeypatch.setattr(queries.models, "live_benchmark", lambda parts, *a, **k: calls.append(parts))
    queries.two_stage_glm(spark, SF)
    (parts,) = calls
    assert [kind for kind, *_ in writes] == ["frame"] and not any("Window" in p._jdf.queryExecution().toString() for p in parts.values())
    assert sum(p.count() for p in parts.values()) == real(spark, SF).na.drop().count()


def test_ranks_are_computed_once(spark, writes, monkeypatch):
    names = spark.createDataFrame([(c, 1.0, 2.0, 3.0) for c in queries.PARTS], "feature string, importance_tweedie double, importance_stage1_cls double, importance_stage2_wet double")
    monkeypatch.setattr(queries.models, "importances", lambda *a, **k: names)
    out = queries.boosted_importances(spark, SF)
    assert [(kind, n) for kind, n, _ in writes] == [("lines", spark.read.parquet(f"{SF}/lineitem.parquet").count()), ("ranks", 10)]
    assert "covar" not in out._jdf.queryExecution().toString() and {r.feature for r in out.collect()} == set(queries.PARTS)
