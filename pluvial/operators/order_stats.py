"""Exact order statistics of whole columns: no task sorts a column or holds its distinct values.

Approximate quantiles, whose state is bounded, put a bracket around every rank
that is asked for; one aggregation then counts exactly how many values lie
below and within each bracket, which proves the bracket or moves it. A bracket
that holds more than BLOCK rows is narrowed again, with the approximation's
error now counted in its own rows. What is left is grouped by value, and
running counts give the value of the rank. All columns and ranks go together,
so a pass reads the table once, however many are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a bracket that may be grouped by value in the last step; accuracy of the approximations; ranks of a pass.
BLOCK, ACCURACY, AT_ONCE, MOST_PASSES = 200_000, 5_000, 40, 60


@dataclass
class _Rank:
    column: str
    k: int  # from 0
    low: float | None = None  # no smaller value has the rank
    high: float | None = None
    below: int = 0  # values under ``low``
    within: int = 0
    value: float | None = None


def _inside(v: Column, low: float | None, high: float | None) -> Column:
    out = v.isNotNull()
    if low is not None:
        out &= v >= low
    return out if high is None else out & (v <= high)


def select(df: DataFrame, columns: dict[str, Column], ranks: dict[str, Sequence[int]], counts: dict[str, int]) -> dict[tuple[str, int], float]:
    """The value of each rank (from 0) of each column of doubles, nulls aside; NaN is larger than all numbers."""
    rows = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    own = {name: F.col(f"c{i}") for i, name in enumerate(columns)}
    todo = [_Rank(name, k, within=counts[name]) for name, ks in ranks.items() for k in sorted(set(ks))]
    done: list[_Rank] = []
    for _ in range(MOST_PASSES):
        wide = [r for r in todo if r.within > BLOCK]
        if not wide:
            break
        for a in range(0, len(wide), AT_ONCE):
            part = wide[a : a + AT_ONCE]
            _narrow(rows, own, part)
        done += [r for r in todo if r.value is not None]
        todo = [r for r in todo if r.value is None]
    else:
        raise RuntimeError("ranks did not settle")
    for a in range(0, len(todo), AT_ONCE):
        _finish(rows, own, todo[a : a + AT_ONCE])
    return {(r.column, r.k): r.value for r in done + todo}


def _narrow(rows: DataFrame, own: dict[str, Column], part: list[_Rank]) -> None:
    """Brackets of about 1 / ACCURACY of what the rank's bracket held; one aggregation to guess, one to count."""
    aggs = []
    for i, r in enumerate(part):
        spot = (r.k - r.below + 0.5) / r.within
        near = [min(1.0, max(0.0, spot + side * 2 / ACCURACY)) for side in (-1, 1)]
        aggs.append(F.percentile_approx(F.when(_inside(own[r.column], r.low, r.high), own[r.column]), near, ACCURACY).alias(f"g{i}"))
    guessed = rows.agg(*aggs).first()  # one row
    counted = []
    for i, r in enumerate(part):
        low, high = guessed[i]
        v = F.when(_inside(own[r.column], r.low, r.high), own[r.column])
        counted += [F.count_if(v < low).alias(f"u{i}"), F.count_if((v >= low) & (v <= high)).alias(f"n{i}"), F.count_if(v == low).alias(f"e{i}"), F.max(F.when(v < low, v)).alias(f"p{i}"), F.min(F.when(v > high, v)).alias(f"s{i}")]
    exact = rows.agg(*counted).first()
    for i, r in enumerate(part):
        (low, high), at = guessed[i], r.k - r.below
        under, n, equal = exact[f"u{i}"], exact[f"n{i}"], exact[f"e{i}"]
        if at < under:
            r.high, r.within = exact[f"p{i}"], under
        elif at >= under + n:
            r.low, r.below, r.within = exact[f"s{i}"], r.below + under + n, r.within - under - n
        elif at < under + equal:
            r.value = low
        elif n == r.within:  # the guess parts nothing: take the ends out
            r.low, r.below, r.within = math.nextafter(low, math.inf), r.below + under + equal, n - equal
        else:
            r.low, r.high, r.below, r.within = low, high, r.below + under, n


def _finish(rows: DataFrame, own: dict[str, Column], part: list[_Rank]) -> None:
    """Groups what the brackets hold, BLOCK rows each at most, by value."""
    held = F.array(*[F.when(_inside(own[r.column], r.low, r.high), F.struct(F.lit(i).alias("i"), own[r.column].alias("v"))) for i, r in enumerate(part)])
    values = rows.select(F.explode(held).alias("x")).where(F.col("x").isNotNull()).groupBy("x.i", "x.v").agg(F.count(F.lit(1)).alias("n"))
    upto = values.withColumn("to", F.sum("n").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    wanted = F.element_at(F.array(*[F.lit(r.k - r.below) for r in part]), F.col("i") + 1)
    found = upto.where((F.col("to") > wanted) & (F.col("to") - F.col("n") <= wanted)).select("i", "v").collect()  # a row for each rank
    for i, v in found:
        part[i].value = v


def percentiles(df: DataFrame, wanted: dict[str, tuple[Column, Sequence[float]]]) -> dict[str, list[float | None]]:
    """For each name the exact percentiles of a column, linear between neighbouring values; None without values."""
    n = df.agg(*[F.count(c.cast("double")).alias(f"n{i}") for i, (c, _) in enumerate(wanted.values())]).first()  # one row
    counts = {name: n[i] for i, name in enumerate(wanted)}
    spots = {name: [p * (counts[name] - 1) for p in ps] for name, (_, ps) in wanted.items() if counts[name]}
    ranks = {name: [k for x in at for k in (math.floor(x), math.ceil(x))] for name, at in spots.items()}
    found = select(df, {name: wanted[name][0] for name in spots}, ranks, counts) if spots else {}

    def between(name: str, x: float) -> float:
        a, b = math.floor(x), math.ceil(x)
        low, high = found[name, a], found[name, b]
        return low if a == b or low == high else (b - x) * low + (x - a) * high

    return {name: [between(name, x) for x in spots[name]] if name in spots else [None] * len(ps) for name, (_, ps) in wanted.items()}
