"""Scalar expressions on columns. All of them stay null on null."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units, fixed values.
KELVIN, GRAVITY = 273.15, 9.80665
#: (offset, factor) of (x + offset) * factor, fixed values.
TO_METRIC = {"fahrenheit": (-32.0, 5.0 / 9.0), "inch": (0.0, 25.4), "knot": (0.0, 0.514444), "mile": (0.0, 1.60934)}


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def finite(c: Column) -> Column:
    """Null for null, NaN and infinities."""
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), c)


def numeric(c: Column) -> Column:
    """A number, or null where the text is none; never an error."""
    return nan_to_null(c.try_cast("double"))


def day(c: Column) -> Column:
    return c.try_cast("date")


def missing_marked(c: Column, mark: float, atol: float = 1e-3, rtol: float = 1e-5) -> Column:
    """Null where the value is as close to ``mark`` as atol + rtol * |mark|."""
    return F.when(~(F.abs(c - mark) <= atol + rtol * abs(mark)), c)


def within(c: Column, low: float, high: float) -> Column:
    """Null outside of [low, high]."""
    return F.when(c.between(low, high), c)


def metric(c: Column, unit: str) -> Column:
    offset, factor = TO_METRIC[unit]
    return (c + F.lit(offset)) * F.lit(factor)


def as_float(c: Column) -> Column:
    return c.cast("float")


def celsius(c: Column) -> Column:
    """From Kelvin, in single precision throughout."""
    return c - F.lit(KELVIN).cast("float")


def hectopascal(c: Column) -> Column:
    return (c / F.lit(100.0).cast("float")).cast("float")


def metres(c: Column) -> Column:
    """From geopotential, in single precision throughout."""
    return (c / F.lit(GRAVITY).cast("float")).cast("float")


def round4(c: Column) -> Column:
    """Half to even at four decimals, in double precision."""
    return F.rint(c * 1e4) / 1e4


def round4_float(c: Column) -> Column:
    """The same in single precision: every step is cut to a float."""
    ten = F.lit(1e4).cast("float")
    return (F.rint((c * ten).cast("float")).cast("float") / ten).cast("float")


def float_as_written(c: Column) -> Column:
    """A float as the double that its shortest decimal reads as, as after a trip through text."""
    return c.cast("string").cast("double")


def quantized(c: Column, step: float = 0.25) -> Column:
    """The nearest multiple of ``step``, half to even, at two decimals."""
    return F.rint(F.rint(c / step) * step * 100) / 100


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def norm(a: Column, b: Column) -> Column:
    return F.sqrt(a * a + b * b)


def cycle(position: Column, period: float) -> tuple[Column, Column]:
    """Sine and cosine of the place in a period."""
    angle = 2 * math.pi * position / period
    return F.sin(angle), F.cos(angle)


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's entry, or the value itself."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.element_at(pairs, c), c)


def labelled(conditions: Sequence[tuple[Column, str]], other: str) -> Column:
    """The label of the first condition that holds; null conditions don't."""
    out = None
    for condition, label in conditions:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return F.lit(other) if out is None else out.otherwise(other)


def clipped(c: Column, low=None, high=None) -> Column:
    """Held within bounds; null stays null."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low) if not isinstance(low, Column) else low)
    if high is not None:
        out = F.least(out, F.lit(high) if not isinstance(high, Column) else high)
    return F.when(c.isNotNull(), out)
