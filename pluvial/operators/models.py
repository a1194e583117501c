"""One-stage and two-stage rain models: boosted trees, and a generalized linear model beside them."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvial.functions.expr import finite

from . import boosting, metrics, order_stats, selection, store
from .boosting import DASHBOARD, EVALUATION, SELECTION, Settings

#: Fewer rainy rows to train on, or to validate on, than these: the dashboard predicts rain by its mean.
LEAST_ROWS, LEAST_RAINY = 30, 10

Predict = Callable[[DataFrame], DataFrame]


def _ready(df: DataFrame, features: Sequence[str], fill: dict[str, float]) -> DataFrame:
    """Features without nulls: infinities and nulls become ``fill``."""
    return df.withColumns({c: F.coalesce(finite(F.col(c).cast("double")), F.lit(fill[c])) for c in features})


def medians(train: DataFrame, features: Sequence[str]) -> dict[str, float]:
    """Exact medians of the finite values of the training rows; 0 where there are none."""
    found = order_stats.percentiles(train, {c: (finite(F.col(c).cast("double")), [0.5]) for c in features})
    return {c: 0.0 if m[0] is None else m[0] for c, m in found.items()}


def tweedie(train: DataFrame, features: Sequence[str], label: str, power: float = 1.3, rounds: int = 25) -> Predict:
    """The linear model: E(y) = exp(x b), with variance mean ** power. Nulls take the training medians."""
    fill = medians(train, features)
    glm = GeneralizedLinearRegression(family="tweedie", variancePower=power, linkPower=0.0, labelCol=label, predictionCol="prediction", regParam=0.01, maxIter=rounds)
    stages = [VectorAssembler(inputCols=list(features), outputCol="_x"), glm.setFeaturesCol("_x")]
    rows, uri = store.written(_ready(train, features, fill).select(*features, label), "linear")  # each round reads them
    model = Pipeline(stages=stages).fit(rows)
    store.removed(train.sparkSession, uri)
    return lambda df: model.transform(_ready(df, features, fill)).drop("_x")


def one_stage(train: DataFrame, features: Sequence[str], label: str, valid: DataFrame | None = None, settings: Settings = EVALUATION) -> boosting.Boosted:
    """Boosted trees under the Tweedie loss; missing values go where a split sends them."""
    return boosting.fit(train, features, label, replace(settings, objective="tweedie"), valid)


class TwoStage:
    """The chance of rain times its amount. ``amount`` is None where too few rows rained; ``mean`` serves then."""

    def __init__(self, chance: boosting.Boosted, amount: boosting.Boosted | None, mean: float):
        self.chance, self.amount, self.mean = chance, amount, mean

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``, not below 0."""
        out = self.chance.predict(df, "_chance")
        if self.amount is None:
            amount = F.lit(float(self.mean))
        else:
            out, amount = self.amount.predict(out, "_log"), F.greatest(F.expm1("_log"), F.lit(0.0))
        return out.withColumn("prediction", F.greatest(F.col("_chance") * amount, F.lit(0.0))).drop("_chance", "_log")


def two_stage(train: DataFrame, features: Sequence[str], rain: str = "target_stage1_rain_label", log_amount: str = "target_stage2_prcp_log1p", settings: Settings = EVALUATION, valid: DataFrame | None = None, fallback: bool = False) -> TwoStage:
    """A rain classifier, and a regressor of log amounts on rainy rows.

    Class weights balance the training rows; validation rows count alike and
    stop each stage by themselves; a second stage without rainy validation rows
    runs all rounds. No rainy training row is an error. ``fallback``, as the
    dashboard does it: with fewer than LEAST_ROWS rainy training rows or
    LEAST_RAINY rainy validation rows their mean amount stands for the regressor.
    """
    chance = boosting.fit(train, features, rain, boosting.with_objective(settings, "binary"), valid, balanced=True)
    wet = lambda df: df.where(F.col(rain) == 1)
    n, mean = wet(train).agg(F.count(F.lit(1)), F.avg(F.expm1(log_amount))).first()  # one row
    if not n and not fallback:
        raise ValueError("no rainy training rows")
    n_valid = 0 if valid is None else wet(valid).count()
    if fallback and (n < LEAST_ROWS or valid is not None and n_valid < LEAST_RAINY):
        return TwoStage(chance, None, mean or 0.0)
    amount = boosting.fit(wet(train), features, log_amount, boosting.with_objective(settings, "squared"), wet(valid) if n_valid else None)
    return TwoStage(chance, amount, mean)


def importances(train: DataFrame, features: Sequence[str], target: str = "target_1stage_prcp_mm", rain: str = "target_stage1_rain_label", log_amount: str = "target_stage2_prcp_log1p", settings: Settings = SELECTION) -> DataFrame:
    """``feature`` and, for the one-stage model and both stages, its number of splits and their gains: trees walked as tables."""
    spark, parts = train.sparkSession, []
    fits = (("importance_tweedie", "tweedie", target, train, False), ("importance_stage1_cls", "binary", rain, train, True), ("importance_stage2_wet", "squared", log_amount, train.where(F.col(rain) == 1), False))
    for name, objective, label, rows, balanced in fits:
        parts.append(boosting.fit(rows, features, label, boosting.with_objective(settings, objective), balanced=balanced).importances(spark, name))
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p), "feature", "full").na.fill(0.0)  # a row for each feature
    return out


def combined(parts: DataFrame, correlations: DataFrame) -> DataFrame:
    """``feature, score``: importances of three models and ``abs_spearman, abs_spearman_rain`` by ``feature``, weighed as selection.WEIGHTS says."""
    return selection.scored(selection.with_correlation(parts, correlations), "feature", selection.WEIGHTS)


def scenarios(parts: dict[str, DataFrame], feature_sets: dict[str, Sequence[str]], target: str = "target_1stage_prcp_mm", lagged: str = "PRCP_lag_1", settings: Settings = EVALUATION, linear: bool = False, dashboard: bool = False) -> DataFrame:
    """The result table: persistence, one-stage and two-stage for each feature set on every part but ``train``.

    A part named ``valid`` also stops the boosting. ``linear``: the generalized
    linear model in place of the one-stage trees. ``dashboard``: nulls take the
    training medians, and too few rainy rows their mean.
    """
    out: list[DataFrame] = []

    def add(df: DataFrame, name: str, feature_set: str, model: str, n: int) -> None:
        row = metrics.regression(df, target, "prediction")
        out.append(row.select(F.lit(feature_set).alias("feature_set"), F.lit(name).alias("scenario"), F.lit(model).alias("model"), F.lit(n).alias("n_features"), F.col("mae").alias("mae_mm"), F.col("rmse").alias("rmse_mm"), "wape_percent", "r2", F.col("bias").alias("bias_mean_pred_minus_true_mm")))

    others = [p for p in parts if p != "train"]
    for name in others:
        add(metrics.persistence(parts[name], lagged), name, "none", "persistence", 0)
    for label, features in feature_sets.items():
        own = parts
        if dashboard:
            fill = medians(parts["train"], features)
            own = {name: _ready(df, features, fill) for name, df in parts.items()}
        train, valid = own["train"], own.get("valid")
        one = tweedie(train, features, target) if linear else one_stage(train, features, target, valid, settings).predict
        two = two_stage(train, features, settings=settings, valid=valid, fallback=dashboard)
        for name in others:
            add(one(own[name]), name, label, "one_stage", len(features))
            add(two.predict(own[name]), name, label, "two_stage", len(features))
    table = out[0]
    for t in out[1:]:
        table = table.unionByName(t)
    return table


def live_benchmark(parts: dict[str, DataFrame], full: Sequence[str], selected: Sequence[str], target: str = "target_1stage_prcp_mm", lagged: str = "PRCP_lag_1", settings: Settings = DASHBOARD, linear: bool = False) -> DataFrame:
    """The dashboard's comparison on the part ``test``: only one feature set where both are the same."""
    sets = {f"full {len(full)}": full} | ({f"selected {len(selected)}": selected} if list(selected) != list(full) else {})
    return scenarios(parts, sets, target, lagged, settings, linear, dashboard=True).where("scenario = 'test'")


def quick_check(train: DataFrame, valid: DataFrame, full: Sequence[str], selected: Sequence[str], target: str = "target_1stage_prcp_mm", settings: Settings = SELECTION) -> DataFrame:
    """``feature_set, n_features`` and the measures of the one-stage model with all and with the selected features."""
    rows = []
    for name, features in (("Full filtered features", full), ("Selected features", selected)):
        found = one_stage(train, features, target, settings=settings).predict(valid)
        rows.append(metrics.regression(found, target, "prediction").select(F.lit(name).alias("feature_set"), F.lit(len(features)).alias("n_features"), "*"))
    return rows[0].unionByName(rows[1])
