"""Choices among column names, made before a plan is built."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def existing(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def required(df: DataFrame, wanted: Iterable[str], kind: str = "double") -> DataFrame:
    """The wanted columns in order; absent ones are null."""
    return df.select(*[F.col(quoted(c)) if c in df.columns else F.lit(None).cast(kind).alias(c) for c in wanted])


def require(df: DataFrame, wanted: Iterable[str]) -> None:
    if absent := [c for c in wanted if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(absent)}")


def without_suffix(df: DataFrame, suffix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.endswith(suffix)])


def trimmed(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def first_of(df: DataFrame, aliases: Sequence[str]) -> str | None:
    """The first alias that names a column, compared without case."""
    own = {c.strip().lower(): c for c in df.columns}
    return next((own[a.lower()] for a in aliases if a.lower() in own), None)


def numeric_columns(df: DataFrame, leave_out: Iterable[str] = ()) -> list[str]:
    out = set(leave_out)
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in out]


def chosen(df: DataFrame, names: Sequence[str], least: int = 0, most: int | None = None, leave_out: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """The names that exist, at most ``most``; all numeric columns if fewer than ``least`` do. And those absent."""
    found = existing(df, names)
    absent = [n for n in names if n not in found]
    if len(found) < least:
        found = numeric_columns(df, leave_out)
    return found[:most], absent


def selection_faults(df: DataFrame, names: Sequence[str], count: int, leaks: Iterable[str]) -> dict[str, list[str]]:
    """What is wrong with a list of feature names: wrong number, repeats, leaks, absent, not numeric."""
    kinds = {f.name: f.dataType for f in df.schema}
    faults = {
        "count": [] if len(names) == count else [str(len(names))],
        "repeated": sorted({n for n in names if list(names).count(n) > 1}),
        "leaks": sorted(set(names) & set(leaks)),
        "absent": [n for n in names if n not in kinds],
        "not_numeric": [n for n in names if n in kinds and not isinstance(kinds[n], NumericType)],
    }
    return {k: v for k, v in faults.items() if v}


# The groups of columns in the order in which they are tried; names as written, names without case,
# and parts of names without case.
GROUPS = (
    ("metadata_time", "names", ("STATION", "time", "DATE", "station_name", "month_name")),
    ("eda_helper", "names without case", ("year", "month", "day", "split", "rain_status", "prcp_label")),
    ("target_or_auxiliary", "names", ("PRCP", "target_1stage_prcp_mm", "target_stage1_rain_label", "target_stage2_prcp_log1p", "PRCP_impute")),
    ("location", "names", ("LATITUDE", "LONGITUDE", "ELEVATION")),
    ("gsod_surface", "names", ("TEMP", "DEWP", "WDSP", "STP", "SLP", "VISIB")),
    ("era5_single_level", "names without case", ("u10", "v10", "t2m", "d2m", "sp", "msl", "z", "lsm", "sst")),
    ("era5_pressure_500hpa", "parts", ("_500",)),
    ("era5_pressure_850hpa", "parts", ("_850",)),
    ("lag_rolling", "parts", ("lag", "rolling", "past", "3d", "7d", "14d", "30d")),
    ("temporal_cyclical", "parts", ("day_sin", "day_cos", "month_sin", "month_cos")),
    ("thermodynamic", "parts", ("dew_point", "lapse", "convection")),
    ("wind_dynamics", "parts", ("wind", "shear", "du_", "dv_", "ageostrophic")),
    ("moisture_flux", "parts", ("moisture", "flux", "q_")),
    ("geometric", "parts", ("thickness", "elevation_diff")),
)
OTHER_GROUP = "other_engineered"


def feature_group(name: str) -> str:
    """The group of a column by its name; the first of GROUPS that fits counts."""
    fits = {"names": lambda own: name in own, "names without case": lambda own: name.lower() in own, "parts": lambda own: any(p in name.lower() for p in own)}
    return next((group for group, kind, own in GROUPS if fits[kind](own)), OTHER_GROUP)


def month_name(time: str) -> Column:
    """The short English name of a date's month."""
    return F.date_format(time, "MMM")
