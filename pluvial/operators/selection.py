"""Feature selection: technical filter, combined score, pruning of correlated features."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Weights of the parts of the score, fixed values.
WEIGHTS = {"importance_tweedie": 0.35, "importance_stage1_cls": 0.25, "importance_stage2_wet": 0.25, "abs_spearman": 0.10, "abs_spearman_rain": 0.05}


def technical(df: DataFrame, columns: Sequence[str], most_missing: float = 0.4) -> DataFrame:
    """``column, missing, distinct, verdict`` in one pass: ok, all_missing, too_sparse or constant."""
    n = F.count(F.lit(1))
    aggs = [F.struct(F.try_divide(F.count_if(F.col(c).isNull()).cast("double"), n).alias("missing"), F.count_distinct(c).alias("distinct")).alias(c) for c in columns]
    rows = df.agg(*aggs).unpivot([], list(columns), "column", "v").select("column", "v.missing", "v.distinct")
    verdict = F.when(F.col("distinct") == 0, "all_missing").when(F.col("missing") > most_missing, "too_sparse").when(F.col("distinct") == 1, "constant").otherwise("ok")
    return rows.withColumn("verdict", verdict)


def scored(parts: DataFrame, name: str, weights: dict[str, float]) -> DataFrame:
    """``score``: weighted sum of the parts, each divided by its maximum (0 if that isn't positive)."""
    tops = parts.agg(*[F.max(F.coalesce(F.col(c), F.lit(0.0))).alias(f"_top_{c}") for c in weights])  # one row
    score = F.lit(0.0)
    for c, w in weights.items():
        top = F.col(f"_top_{c}")
        score = score + w * F.when(top > 0, F.coalesce(F.col(c), F.lit(0.0)) / top).otherwise(0.0)
    return parts.join(F.broadcast(tops)).select(name, score.alias("score"))


def with_correlation(importances: DataFrame, correlations: DataFrame, name: str = "feature") -> DataFrame:
    """Importances with correlations beside them; features that were not correlated have 0."""
    return importances.join(correlations, name, "left").na.fill(0.0)


def pruned(names: Iterable[str], correlation: dict[tuple[str, str], float], most: int = 46, limit: float = 0.95) -> list[str]:
    """Names in order, without those that correlate with a kept one by ``limit`` or more, up to ``most``.

    Runs on the driver, over feature names.
    """
    kept: list[str] = []
    for n in names:
        if len(kept) == most:
            break
        if all(abs(correlation.get((n, k), correlation.get((k, n), 0.0)) or 0.0) < limit for k in kept):
            kept.append(n)
    return kept
