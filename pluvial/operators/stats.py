"""Correlations and ranking measures."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as win

#: Distinct values of a column whose ranks may be broadcast.
BROADCAST_VALUES = 100_000


def correlation(a: Column, b: Column) -> Column:
    """Pearson's r over rows where both are known; null if either is constant there."""
    a, b = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, r`` for every two columns, over rows where both are known: one aggregation."""
    pairs = list(combinations(columns, 2))
    aggs = [correlation(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    rows = df.agg(*aggs).unpivot([], [f"p{i}" for i in range(len(pairs))], "_p", "r")
    return _named(rows, pairs)


def _named(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    place = F.substring("_p", 2, 9).cast("int") + 1
    names = [F.array(*[F.lit(p[i]) for p in pairs]) for i in (0, 1)]
    return rows.select(F.element_at(names[0], place).alias("a"), F.element_at(names[1], place).alias("b"), "r")


def _ranked(rows: DataFrame, columns: Sequence[str], known: dict[str, tuple[int, list[float]]]) -> DataFrame:
    """Each column replaced by its rank with ties averaged. A value is ranked once, however many rows have it."""
    given = rows
    for c in columns:
        distinct, quantiles = known[c]
        counts = given.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_own"))
        ranks = win.running(counts, c, win.splits(quantiles), {"_under": "_own"}).select(c, (F.col("_under") + (F.col("_own") + 1) / 2).alias(f"_r_{c}"))
        rows = rows.join(F.broadcast(ranks) if distinct <= BROADCAST_VALUES else ranks.hint("merge"), c).drop(c).withColumnRenamed(f"_r_{c}", c)
    return rows


def spearman_pairs(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """``a, b, r``: rank correlation over rows where both are known.

    Columns without nulls are ranked once for all their pairs; a pair with
    nulls is ranked over the rows that it has whole. Ranks come from counts of
    distinct values by running sums in two steps (``windows.running``), so no
    task sorts a whole column, and a value that many rows share is one.
    """
    pairs = list(pairs or combinations(columns, 2))
    names = sorted({x for p in pairs for x in p})
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    blocks = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    about = rows.agg(*[F.struct(F.count_if(F.col(c).isNull()).alias("nulls"), F.approx_count_distinct(c).alias("distinct"), win.quantiles_of(F.col(c), blocks).alias("q")).alias(c) for c in names]).first()  # one row
    known = {c: (about[c]["distinct"] * 1.2, about[c]["q"]) for c in names}
    whole = [p for p in pairs if not any(about[c]["nulls"] for c in p)]
    parts = [whole] if whole else []
    parts += [[p] for p in pairs if p not in whole]
    out = None
    for group in parts:
        own = sorted({x for p in group for x in p})
        held = rows.select(*own).where(F.forall(F.array(*own), lambda x: x.isNotNull()))
        ranked = _ranked(held, own, known)
        found = ranked.agg(*[correlation(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(group)]).unpivot([], [f"p{i}" for i in range(len(group))], "_p", "r")
        found = _named(found, group)
        out = found if out is None else out.unionByName(found)
    return out


def strongest(pairs: DataFrame, k: int) -> DataFrame:
    """``column, strength``: mean absolute correlation with the others, the ``k`` largest."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("column"), F.abs("r").alias("r"))
    return ends.groupBy("column").agg(F.avg("r").alias("strength")).orderBy(F.desc("strength"), "column").limit(k)


def _steps(df: DataFrame, label: str, score: str) -> DataFrame:
    """One row for each distinct score: positives and negatives at it."""
    known = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    return known.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum((1 - F.col(label)).cast("bigint")).alias("n"))


def _borders(df: DataFrame, score: str) -> list[float]:
    blocks = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return win.splits(df.agg(win.quantiles_of(F.col(score).cast("double"), blocks)).first()[0])  # one row


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """``roc_auc``: chance that a positive scores above a negative, ties half. Running sums over distinct scores, in two steps."""
    steps = win.running(_steps(df, label, score), "s", _borders(df, score), {"under": "n"})
    won = F.sum(F.col("p") * (F.col("under") + F.col("n") / 2))
    return steps.agg(F.try_divide(won, F.sum("p") * F.sum("n")).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """``average_precision``: sum of precision times the step in recall, by falling distinct scores."""
    steps = win.running(_steps(df, label, score), "s", _borders(df, score), {"p_under": "p", "n_under": "n"})
    all_p, all_n = (F.sum(c).alias(f"all_{c}") for c in ("p", "n"))
    totals = steps.agg(all_p, all_n)  # one row
    steps = steps.join(F.broadcast(totals)).withColumns({"tp": F.col("all_p") - F.col("p_under"), "all": F.col("all_p") - F.col("p_under") + F.col("all_n") - F.col("n_under")})
    return steps.agg(F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("all")), F.sum("p")).alias("average_precision"))
