"""Staged imputation. Each stage reads the output of the one before."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order_stats, store
from . import windows as win


def filled_from(pairs: dict[str, str]) -> dict[str, Column]:
    """Columns that take another column's value where they are null."""
    return {c: F.coalesce(F.col(c), F.col(other)) for c, other in pairs.items()}


def cascade(df: DataFrame, c: str, station: str, season: Column, time: str, limit: int = 2) -> DataFrame:
    """``c`` without nulls: last value up to ``limit`` rows back, then the station's median in the
    season, then the station's median, then the median of all, each of the stage before.

    The medians cover the whole period, later rows included; not for targets.
    The rows are written to the shared folder before the last stage, whose
    median is exact and found in a few passes (``order_stats``).
    """
    out = df.withColumn(c, win.carried(c, win.by([station], time), limit)).withColumn("_season", season)
    for keys in ([station, "_season"], [station]):
        out = out.withColumn(c, F.coalesce(F.col(c), F.median(c).over(Window.partitionBy(*keys))))
    out, _ = store.written(out.drop("_season"), "cascade")
    (overall,) = order_stats.percentiles(out, {c: (F.col(c), [0.5])})[c]
    return out.withColumn(c, F.coalesce(F.col(c), F.lit(overall).cast("double")))


def past_proxy(df: DataFrame, c: str, station: str, season: Column, time: str, out: str, limit: int = 2, window: bool = False) -> DataFrame:
    """``out``: a value for the null rows of ``c`` from strictly earlier rows, null elsewhere; ``c`` stays as it is.

    Last value up to ``limit`` rows back, else the median of the station's
    earlier values in the season, else of all its earlier values, else 0.
    ``window``: medians by window frames, for short keys; else by a join of
    the null rows.
    """
    w = win.by([station], time)
    made = df.withColumn("_carried", win.carried(c, w, limit)).withColumn("_season", season)
    if window:
        made = made.withColumns({"_m1": win.past_median_window(c, [station, "_season"], time), "_m2": win.past_median_window(c, [station], time)})
    else:
        made = win.with_past_medians(made, c, [station], time, {"_m1": ["_season"], "_m2": []}, F.col("_carried").isNull())
    proxy = F.when(F.col(c).isNull(), F.coalesce("_carried", "_m1", "_m2", F.lit(0.0)))
    return made.withColumn(out, proxy).drop("_carried", "_season", "_m1", "_m2")


def fill_with_medians(train: DataFrame, others: Sequence[DataFrame], columns: Sequence[str]) -> list[DataFrame]:
    """Nulls of all tables replaced by the medians of ``train``; 0 where train has no value."""
    medians = order_stats.percentiles(train, {c: (F.col(c), [0.5]) for c in columns})
    fill = {c: 0.0 if m is None else m for c, (m,) in medians.items()}
    return [t.na.fill(fill) for t in (train, *others)]
