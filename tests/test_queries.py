"""Every query with SQL gives the rows of that SQL."""

import pytest

from pluvial.plans import queries

from .oracle import ordered, sql_rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_rows_equal_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns, rows = ordered(df.columns, [tuple(r) for r in df.collect()])
    want_columns, want = ordered(*sql_rows(queries.SQL[name], SF))
    assert columns == want_columns
    assert rows == want


def test_models_beat_nothing(spark):
    rows = queries.two_stage_glm(spark, "/root/testdata/sf0.001").collect()
    assert {(r.feature_set, r.model) for r in rows} == {("none", "persistence"), ("full 4", "one_stage"), ("full 4", "two_stage"), ("selected 2", "one_stage"), ("selected 2", "two_stage")}
    assert all(r.mae_mm > 0 for r in rows)
