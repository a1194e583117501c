"""Regression measures, in the evaluation's and the dashboard's variant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regression(df: DataFrame, true: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """``n, mae, rmse, wape_percent, r2, bias`` over rows where both are known; null where a divisor is 0."""
    y, p = F.col(true), F.col(predicted)
    known = df.where(y.isNotNull() & p.isNotNull())
    e = p - y
    sums = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.when(F.sum(F.abs(y)) > 0, 100 * F.sum(F.abs(e)) / F.sum(F.abs(y))).alias("wape_percent"),
        F.sum(e * e).alias("_see"), (F.var_pop(y) * F.count(y)).alias("_syy"), F.avg(e).alias("bias"),
    )
    r2 = F.when(F.col("_syy") > 0, 1 - F.col("_see") / F.col("_syy"))
    return sums.select(*keys, "n", "mae", "rmse", "wape_percent", r2.alias("r2"), "bias")


def regression_clipped(df: DataFrame, true: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """The dashboard's variant: only finite pairs count, predictions under 0 are 0, r2 needs two rows."""
    y, p = F.col(true), F.greatest(F.col(predicted), F.lit(0.0))
    finite = ~F.isnan(y) & (F.abs(y) < float("inf")) & ~F.isnan(F.col(predicted)) & (F.abs(F.col(predicted)) < float("inf"))
    out = regression(df.where(finite).withColumn("_p", p), true, "_p", keys)
    return out.withColumn("r2", F.when(F.col("n") >= 2, F.col("r2")))


def persistence(df: DataFrame, lagged: str, out: str = "prediction", fill: bool = False) -> DataFrame:
    """Tomorrow is as today, not below 0. Rows without a lag go, or with ``fill`` predict 0."""
    df = df if fill else df.where(F.col(lagged).isNotNull())
    return df.withColumn(out, F.greatest(F.coalesce(F.col(lagged), F.lit(0.0)), F.lit(0.0)))
