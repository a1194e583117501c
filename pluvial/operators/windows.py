"""Row windows over stations in time. Frames are counted in rows, so they are
days only on a dense frame (``frame.dense``)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(keys: Sequence[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def lag(c: str, w, rows: int = 1) -> Column:
    return F.lag(c, rows).over(w)


def diff(c: str, w) -> Column:
    return F.col(c) - F.lag(c).over(w)


def past_mean(c: Column, w, rows: int = 3) -> Column:
    """Mean of the ``rows`` rows before this one, of those that are not null."""
    return F.avg(c).over(w.rowsBetween(-rows, -1))


def past_sum(c: Column, w, rows: int = 3) -> Column:
    return F.sum(c).over(w.rowsBetween(-rows, -1))


def carried(c: str, w, rows: int) -> Column:
    """The last value that is not null, at most ``rows`` rows back."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(-rows, 0))


def carried_both(c: str, w) -> Column:
    """The last value before, else the first one after."""
    forward = F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = F.first(c, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return F.coalesce(forward, back)


def past_median_window(c: str, keys: Sequence[str], order: str) -> Column:
    """Median of all strictly earlier rows of the key. Quadratic in a key's rows: for short keys."""
    return F.percentile(F.col(c), F.lit(0.5)).over(by(keys, order).rowsBetween(Window.unboundedPreceding, -1))


def with_past_median(df: DataFrame, c: str, keys: Sequence[str], order: str, out: str, where: Column | None = None) -> DataFrame:
    """The same median as a column, computed only for the rows ``where`` (default: ``c`` is null), else null."""
    return with_past_medians(df, c, keys, order, {out: ()}, where)


def with_past_medians(df: DataFrame, c: str, keys: Sequence[str], order: str, outs: dict[str, Sequence[str]], where: Column | None = None) -> DataFrame:
    """Medians of the strictly earlier values of a key, for each of ``outs`` of those that also agree in its columns.

    Only the rows ``where`` (default: ``c`` is null) get one; see
    ``past_medians``. (keys, order) has to identify a row.
    """
    from . import past_medians

    found = past_medians.medians(df, c, keys, order, outs, F.col(c).isNull() if where is None else where)
    return df.join(found, [*keys, order], "left")


def splits(values: Sequence[float] | None) -> list[float]:
    """Borders of blocks of values, from quantiles."""
    inner = sorted({float(v) for v in values or () if v is not None and abs(v) < float("inf")})
    return [-float("inf"), *(inner or [0.0]), float("inf")]


def quantiles_of(c: Column, blocks: int) -> Column:
    return F.percentile_approx(c, [i / blocks for i in range(1, blocks)], 10 * blocks)


def running(rows: DataFrame, value: str, borders: list[float], sums: dict[str, str]) -> DataFrame:
    """For each of ``sums`` (new column: summed one) the sum over all rows of smaller ``value``.

    The sum runs in two steps, over the blocks between ``borders`` and within
    each block, so no task sorts all rows. ``value`` has to be distinct and not
    null; NaN counts as largest. The sums by block have a row for each block.
    """
    placed = Bucketizer(splits=borders, inputCol="_as_double", outputCol="_block", handleInvalid="keep").transform(rows.withColumn("_as_double", F.col(value).cast("double"))).drop("_as_double")
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    inside = Window.partitionBy("_block").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("_block").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums.values()])
    totals = totals.select("_block", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in sums.values()])
    out = placed.join(F.broadcast(totals), "_block")
    return out.withColumns({new: F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in sums.items()}).drop("_block", *[f"_b_{c}" for c in sums.values()])
