"""Result tables of the models, ready to print."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvial.functions.expr import mapped, round4

from .joins import side_by_side

VALUES = ("n_features", "mae_mm", "rmse_mm", "wape_percent", "r2", "bias_mean_pred_minus_true_mm")


def compared(results: DataFrame, a: str = "full", b: str = "selected") -> DataFrame:
    """Both feature sets of each scenario and model in one row."""
    return side_by_side(results, ["scenario", "model"], "feature_set", [a, b], VALUES)


def printable(results: DataFrame, labels: dict[str, str] | None = None) -> DataFrame:
    """Rounded numbers, labels in place of names, in a fixed order of rows."""
    names = {"one_stage": "one-stage", "two_stage": "two-stage"} | (labels or {})
    numbers = {f.name: round4(F.col(f.name)) for f in results.schema if f.dataType.simpleString() == "double"}
    out = results.withColumns(numbers | {c: mapped(F.col(c), names) for c in ("feature_set", "scenario", "model") if c in results.columns})
    return out.orderBy(*[c for c in ("scenario", "feature_set", "model") if c in out.columns])


def best(results: DataFrame, measure: str = "mae_mm", keys=("scenario",)) -> DataFrame:
    """The model of the smallest measure for each key."""
    return results.groupBy(*keys).agg(F.min_by("model", measure).alias("model"), F.min(measure).alias(measure))
