"""Dense frames, first values, deduplication, resampling, and the level pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def calendar(keys: DataFrame, start: Column, end: Column, name: str = "time") -> DataFrame:
    """Every row of ``keys`` on every day from start to end."""
    return keys.withColumn(name, F.explode(F.sequence(start, end, F.expr("interval 1 day"))))


def dense(obs: DataFrame, key: str, time: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row for each key and day; days without an observation are null.

    Without given ends the days run from the first to the last of all keys:
    one row of bounds, joined to the distinct keys.
    """
    keys = obs.select(key).where(F.col(key).isNotNull()).distinct()
    if start is None or end is None:
        bounds = obs.agg(F.min(time).alias("_start"), F.max(time).alias("_end"))
        days = calendar(keys.join(F.broadcast(bounds)), F.col("_start"), F.col("_end"), time).drop("_start", "_end")
    else:
        days = calendar(keys, F.lit(start).cast("date"), F.lit(end).cast("date"), time)
    return days.join(obs, [key, time], "left")


def first_valid(c: str, order: str) -> Column:
    """The earliest value that is not null; of several at one time the least."""
    return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c))))


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row for each key: the first in ``order``, which should be total."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def daily(df: DataFrame, keys: Sequence[str], time: str, means: Sequence[str], firsts: Sequence[str] = (), name: str = "time") -> DataFrame:
    """Daily means (in the columns' own width) and first values, with a row for each
    day between a key's first and last, empty ones as null."""
    day = F.to_date(time)
    kinds = dict(df.dtypes)
    aggs = [F.avg(c).cast(kinds[c]).alias(c) for c in means] + [first_valid(c, time).alias(c) for c in firsts]
    found = df.withColumn(name, day).groupBy(*keys, name).agg(*aggs) if name != time else df.withColumn("_day", day).groupBy(*keys, "_day").agg(*aggs).withColumnRenamed("_day", name)
    span = found.groupBy(*keys).agg(F.min(name).alias("_start"), F.max(name).alias("_end"))
    days = calendar(span, F.col("_start"), F.col("_end"), name).drop("_start", "_end")
    return days.join(found, [*keys, name], "left")


def levels_wide(df: DataFrame, keys: Sequence[str], level: str, levels: Sequence, values: Sequence[str]) -> DataFrame:
    """``value_level`` columns of numbers; only keys that have every level. One aggregation in place of self-joins.
    ``keys`` should tell the rows of a level apart; of those that they don't, the mean stays."""
    kinds = dict(df.dtypes)
    aggs = [F.avg(F.when(F.col(level) == x, F.col(v))).cast(kinds[v]).alias(f"{v}_{x}") for x in levels for v in values]
    seen = [F.max(F.when(F.col(level) == x, 1)).alias(f"_has_{i}") for i, x in enumerate(levels)]
    wide = df.where(F.col(level).isin(list(levels))).groupBy(*keys).agg(*aggs, *seen)
    for i in range(len(levels)):
        wide = wide.where(F.col(f"_has_{i}").isNotNull()).drop(f"_has_{i}")
    return wide


def array_rows(df: DataFrame, values: Sequence[str], axes: Sequence[tuple[str, str]]) -> DataFrame:
    """A row for each cell of array columns.

    ``axes``: (name of the new column, array of coordinates), slowest first; the
    arrays ``values`` are nested by axis, or flat in that order. Cells go by
    their position; where an array is null, its cells are. A row whose axes are
    empty or null gives no rows; an array of the wrong size is an error.
    """
    def flat(c: str) -> Column:
        out, kind = F.col(c), df.schema[c].dataType.elementType
        while isinstance(kind, ArrayType):
            out, kind = F.flatten(out), kind.elementType
        return out

    sizes = [F.size(F.col(a)) for _, a in axes]
    cells = F.lit(1)
    for n in sizes:
        cells = cells * F.greatest(n, F.lit(0))
    kept = [c for c in df.columns if c not in {*values, *(a for _, a in axes)}]
    whole = [F.when(flat(c).isNull() | (F.size(flat(c)) == cells), flat(c)).otherwise(F.raise_error(F.lit(f"{c}: not a value for each cell"))).alias(c) for c in values]
    out = df.where(cells > 0).select(*[F.col(f"`{c}`") for c in kept], *[a for a in dict.fromkeys(a for _, a in axes)], *whole)
    out = out.select("*", F.explode(F.sequence(F.lit(0), cells - 1)).alias("_at"))
    place, made = F.col("_at"), {}
    for (name, a), n in zip(reversed(axes), reversed(sizes), strict=True):
        made[name] = F.get(F.col(a), F.pmod(place, n))
        place = F.floor(place / n).cast("int")
    return out.select(*[F.col(f"`{c}`") for c in kept], *[made[name].alias(name) for name, _ in axes], *[F.get(F.col(c), F.col("_at")).alias(c) for c in values])
