"""Joins of stations with metadata and grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvial.functions.expr import quantized

#: A side of at most so many counted rows may be broadcast.
BROADCAST_ROWS = 200_000


def small(side: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it has few rows; otherwise it is shuffled. The count stops at the bound."""
    return F.broadcast(side) if side.limit(most + 1).count() <= most else side


def with_metadata(df: DataFrame, meta: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(small(meta), list(keys), "left")


#: The cell of a row, and the same columns of a grid. Names differ from a station's place even without case.
CELL, GRID_CELL = ("cell_lat", "cell_lon"), ("latitude", "longitude")


def cells_of(df: DataFrame, latitude: str, longitude: str, step: float = 0.25) -> DataFrame:
    """The grid cell of each row, as the columns CELL."""
    return df.withColumns({c: quantized(F.col(x), step) for c, x in zip(CELL, (latitude, longitude), strict=True)})


def with_grid(df: DataFrame, grid: DataFrame, time: str = "time") -> DataFrame:
    """Grid values at each row's cell and time. The grid is first cut to the cells that occur: they are few."""
    cells = df.select(*CELL).distinct()
    named = grid.withColumnsRenamed(dict(zip(GRID_CELL, CELL, strict=True)))
    held = named.join(small(cells), list(CELL), "left_semi")
    return df.join(held, [time, *CELL], "left")


def matching(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(side.select(*keys), list(keys), "left_semi")


def unmatched(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(side.select(*keys), list(keys), "left_anti")


def outer_filled(a: DataFrame, b: DataFrame, key: str, fill: float = 0.0) -> DataFrame:
    """Full outer join; numbers that are absent become ``fill``."""
    return a.join(b, key, "full").na.fill(fill)


def side_by_side(results: DataFrame, keys: Sequence[str], variant: str, variants: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The rows of two variants next to each other, for keys that have both: one aggregation, no self-join."""
    aggs: list[Column] = [F.max(F.when(F.col(variant) == x, F.col(v))).alias(f"{v}_{x}") for v in values for x in variants]
    both = F.count_distinct(F.when(F.col(variant).isin(list(variants)), F.col(variant)))
    return results.groupBy(*keys).agg(*aggs, both.alias("_both")).where(F.col("_both") == len(variants)).drop("_both")
