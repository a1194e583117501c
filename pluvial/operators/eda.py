"""Summary tables. Each is one aggregation of its input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import order_stats


def long(df: DataFrame, metrics: dict[str, Column], name: str = "metric", value: str = "value") -> DataFrame:
    """One row for each aggregate, as doubles."""
    return df.agg(*[c.cast("double").alias(k) for k, c in metrics.items()]).unpivot([], list(metrics), name, value)


def overview(df: DataFrame, station: str, time: str, x: str, threshold: float = 0.1) -> DataFrame:
    """``metric, value``; medians and percentiles are exact, by ``order_stats``."""
    v, n = F.col(x), F.count(F.lit(1))
    exact = order_stats.percentiles(df, {"all": (v, [0.5, 0.95, 0.99]), "rainy": (F.when(v >= threshold, v), [0.5])})
    median, p95, p99, rainy_median = (F.lit(q).cast("double") for q in exact["all"] + exact["rainy"])
    known = F.count(v)
    rainy = F.count_if(v >= threshold)
    metrics = {
        "rows": n, "stations": F.count_distinct(station), "days": F.count_distinct(time), "years": F.count_distinct(F.year(time)),
        "known": known, "missing": n - known, "missing_percent": F.try_divide((n - known) * 100.0, n),
        "zero": F.count_if(v == 0), "rainy": rainy, "dry": F.count_if(v < threshold), "rainy_percent": F.try_divide(rainy * 100.0, known),
        "sum": F.coalesce(F.sum(v), F.lit(0.0)), "mean": F.avg(v), "median": median, "p95": p95, "p99": p99,
        "min": F.min(v), "max": F.max(v), "rainy_mean": F.avg(F.when(v >= threshold, v)), "rainy_median": rainy_median, "rainy_max": F.max(F.when(v >= threshold, v)),
    }
    return long(df, metrics)


def missing_per_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, missing, percent``."""
    columns = list(columns or df.columns)
    n = F.count(F.lit(1))
    counts = df.agg(n.alias("_n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    out = counts.unpivot(["_n"], columns, "column", "missing")
    return out.select("column", "missing", F.try_divide(F.col("missing") * 100.0, F.col("_n")).alias("percent"))


def missing_by(df: DataFrame, keys: Sequence[str | Column], x: str, threshold: float = 0.1) -> DataFrame:
    """Counts and rates of missing and rainy rows by key; a null key is a group of its own."""
    v, n = F.col(x), F.count(F.lit(1))
    known, rainy = F.count(v), F.count_if(v >= threshold)
    return df.groupBy(*keys).agg(
        n.alias("rows"), known.alias("known"), (n - known).alias("missing"), F.try_divide((n - known) * 100.0, n).alias("missing_percent"),
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.max(v).alias("max"), rainy.alias("rainy"), F.try_divide(rainy * 100.0, known).alias("rainy_percent"),
    )


def quantiles(df: DataFrame, x: str, probabilities: Sequence[float], subsets: dict[str, Column]) -> DataFrame:
    """``subset, probability, value``: exact, linear between values, by ``order_stats``; null for an empty subset."""
    found = order_stats.percentiles(df, {k: (F.when(c, F.col(x)), probabilities) for k, c in subsets.items()})
    rows = [(k, float(p), q) for k, qs in found.items() for p, q in zip(probabilities, qs, strict=True)]
    return df.sparkSession.createDataFrame(rows, "subset string, probability double, value double")


def value_counts(df: DataFrame, c: Column, categories: Sequence[str]) -> DataFrame:
    """``place, category, count`` for a fixed list, absent ones with 0."""
    listed = df.sparkSession.createDataFrame(list(enumerate(categories)), "place int, category string")
    counts = df.select(c.alias("category")).groupBy("category").count()
    return F.broadcast(listed).join(counts, "category", "left").na.fill(0, ["count"]).select("place", "category", "count")


def seasonality(df: DataFrame, key: Column, name: str, x: str, threshold: float = 0.1) -> DataFrame:
    v = F.col(x)
    return df.where(v.isNotNull()).groupBy(key.alias(name)).agg(
        F.avg((v >= threshold).cast("double")).alias("rain_probability"), F.sum(v).alias("sum"), F.count(v).alias("count"),
        F.avg(v).alias("mean"), F.median(v).alias("median"), F.percentile(v, F.lit(0.95)).alias("p95"), F.max(v).alias("max"),
    )


def summary(df: DataFrame, keys: Sequence[Column], x: str, time: str, threshold: float = 0.1) -> DataFrame:
    """By station, year or split: counts, rates, mean, quantiles and time span; null keys are left out."""
    v = F.col(x)
    keep = df
    for k in keys:
        keep = keep.where(k.isNotNull())
    return keep.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("known"), F.coalesce(F.sum(v), F.lit(0.0)).alias("sum"), F.avg(v).alias("mean"), F.median(v).alias("median"),
        F.percentile(v, F.lit(0.95)).alias("p95"), F.percentile(v, F.lit(0.99)).alias("p99"), F.max(v).alias("max"),
        F.try_divide(F.count_if(v >= threshold) * 100.0, F.count(v)).alias("rainy_percent"), F.min(time).alias("first"), F.max(time).alias("last"),
    )


def station_summary(df: DataFrame, station: str, name: str, time: str) -> DataFrame:
    """A row for each station; its name is that of its first row, the smallest of several at that time."""
    return df.groupBy(station).agg(
        F.min_by(name, F.struct(F.col(time), F.col(name))).alias("station_name"), F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.year(time)).alias("n_years"),
        F.min(time).alias("start_date"), F.max(time).alias("end_date"), F.count_distinct(F.to_date(time)).alias("n_unique_days"),
    )


def dataset(df: DataFrame, station: str, time: str, target: str) -> DataFrame:
    """One row: rows, stations, first and last day, rows with a target. ``columns`` is known without reading."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(df.columns)).alias("columns"), F.count_distinct(station).alias("stations"),
        F.min(time).alias("first"), F.max(time).alias("last"), F.count(target).alias("with_target"),
    )


def group_missingness(missing: DataFrame, groups: dict[str, str]) -> DataFrame:
    """``missing_per_column``'s rows by group of columns: number, and average, largest and smallest percentage."""
    pairs = F.create_map(*[F.lit(x) for kv in groups.items() for x in kv])
    of = missing.withColumn("group", F.element_at(pairs, F.col("column")))
    return of.groupBy("group").agg(F.count(F.lit(1)).alias("columns"), F.avg("percent").alias("average"), F.max("percent").alias("largest"), F.min("percent").alias("smallest"))


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """``bin`` (from 1), ``low``, ``high``, ``count`` over equal widths from least to largest; the last bin holds the maximum."""
    bounds = df.agg(F.min(x).alias("_a"), F.max(x).alias("_b"))
    both = df.where(F.col(x).isNotNull()).join(F.broadcast(bounds))  # one row
    width = (F.col("_b") - F.col("_a")) / bins
    spot = F.when(F.col("_b") > F.col("_a"), F.least(F.floor((F.col(x) - F.col("_a")) / width) + 1, F.lit(bins))).otherwise(1)
    counts = both.groupBy(spot.cast("int").alias("bin")).count()
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin")).join(F.broadcast(bounds))
    every = every.select("bin", (F.col("_a") + (F.col("bin") - 1) * width).alias("low"), (F.col("_a") + F.col("bin") * width).alias("high"))
    return every.join(counts, "bin", "left").na.fill(0, ["count"])


def boxes(df: DataFrame, key: str | Column, x: str) -> DataFrame:
    """Quartiles, and the outermost values within 1.5 times their distance."""
    v = F.col(x)
    quarters = df.where(v.isNotNull()).withColumn("_key", F.col(key) if isinstance(key, str) else key)
    q = quarters.groupBy("_key").agg(*[F.percentile(v, F.lit(p)).alias(n) for p, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = quarters.join(q, "_key").where(v.between(F.col("q1") - reach, F.col("q3") + reach))
    ends = inside.groupBy("_key").agg(F.min(v).alias("low"), F.max(v).alias("high"))
    return q.join(ends, "_key").withColumnRenamed("_key", "key")


def pivoted(df: DataFrame, row: str, column: Column, values: Sequence, cell: Column) -> DataFrame:
    return df.withColumn("_column", column).groupBy(row).pivot("_column", list(values)).agg(cell)


def density(df: DataFrame, x: str, points: Sequence[float], bandwidth: float) -> DataFrame:
    """``point, density``: a Gaussian kernel sum at each point, in one aggregation."""
    norm = bandwidth * (2 * 3.141592653589793) ** 0.5
    sums = [F.avg(F.exp(-0.5 * ((F.col(x) - p) / bandwidth) ** 2) / norm).alias(f"p{i}") for i, p in enumerate(points)]
    rows = df.agg(*sums).unpivot([], [f"p{i}" for i in range(len(points))], "_p", "density")
    at = F.array(*[F.lit(float(p)) for p in points])
    return rows.select(F.element_at(at, F.substring("_p", 2, 9).cast("int") + 1).alias("point"), "density")


def top(df: DataFrame, score: Column, name: str, k: int) -> DataFrame:
    """The ``k`` rows of largest score, ties by name."""
    return df.orderBy(score.desc_nulls_last(), F.col(name)).limit(k)


def ranked(df: DataFrame, score: str, name: str) -> DataFrame:
    """``rank`` from 1 by falling score; for short tables, as it sorts them in one task."""
    return df.withColumn("rank", F.row_number().over(Window.orderBy(F.col(score).desc(), F.col(name))))
