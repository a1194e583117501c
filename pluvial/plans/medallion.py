"""Bronze to silver to gold: one plan, written once, with its checks counted on the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvial.functions import expr
from pluvial.functions.columns import existing, require, required
from pluvial.operators import features, frame, impute, joins, store, validate
from pluvial.operators import windows as win
from pluvial.sources.schemas import LEVELS, MARKS, OBSERVED, PRESSURE_RANGE, UNITS

SUPPORT = ("t2m", "d2m", "msl", "sp", "sst")
STATIONARY = ("z", "lsm")
#: What tells apart grid rows of one time, cell and level, such as the members of an ensemble.
MEMBER = ("number", "step", "valid_time")


def observations(bronze: DataFrame) -> DataFrame:
    """Station-days in metric units: numbers or null, one row each, marks and impossible pressures gone.

    Marks and ranges are tested in the source's units, so before conversion. Of
    several rows of a station-day the first by all columns stays. Rows without
    a station or a readable day go.
    """
    df = required(bronze, ("STATION", "DATE", "LATITUDE", "LONGITUDE", "ELEVATION", *OBSERVED), "string")
    df = df.withColumns({"STATION": F.col("STATION").cast("string"), "time": expr.day(F.col("DATE"))}).where("STATION is not null and time is not null")
    df = df.withColumns({c: expr.numeric(F.col(c)) for c in ("LATITUDE", "LONGITUDE", "ELEVATION", *OBSERVED)})
    df = frame.keep_first(df, ["STATION", "time"], ["DATE", *OBSERVED, "LATITUDE", "LONGITUDE", "ELEVATION"])
    df = df.withColumns({c: expr.missing_marked(F.col(c), m) for c, m in MARKS.items()})
    df = df.withColumns({c: expr.within(F.col(c), *PRESSURE_RANGE) for c in ("STP", "SLP")})
    return df.withColumns({c: expr.metric(F.col(c), u) for c, u in UNITS.items()}).drop("DATE")


def single_daily(grid: DataFrame, north: float = 24, south: float = 8, west: float = 102, east: float = 110) -> DataFrame:
    """Daily cells of the single-level grid, in °C, hPa and m, all in single precision."""
    require(grid, ("time", "latitude", "longitude"))
    held = grid.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    change = {c: expr.celsius(F.col(c)) for c in existing(grid, ("t2m", "d2m", "sst"))}
    change |= {c: expr.hectopascal(F.col(c)) for c in existing(grid, ("msl", "sp"))}
    change |= {c: expr.metres(F.col(c)) for c in existing(grid, ("z",))}
    means = existing(grid, ("t2m", "d2m", "sst", "u10", "v10", "sp", "msl", "z"))
    return frame.daily(held.withColumns(change), ["latitude", "longitude"], "time", means, existing(grid, ("lsm",)))


def pressure_daily(grid: DataFrame, levels=LEVELS, north: float = 24, south: float = 8, west: float = 102, east: float = 110, audit: validate.Audit | None = None) -> DataFrame:
    """Daily cells of the pressure grid within the box, a column for each variable and level; cells need both levels.

    Levels meet by time, cell and those columns of MEMBER that the grid has; the means go over all members.
    Absent levels are an error: at once, or in the report of ``audit``.
    """
    grid = grid.where(F.col("latitude").between(south, north) & F.col("longitude").between(west, east))
    if audit is not None:
        grid = audit.watch(grid, "pressure", present={f"level_{x}_is_there": F.col("isobaricInhPa") == x for x in levels})
    elif gone := validate.absent_levels(grid, "isobaricInhPa", levels):
        raise validate.Violation(f"levels absent: {gone}")
    change = {"t": expr.celsius(F.col("t")), "z": expr.metres(F.col("z"))}
    wide = frame.levels_wide(grid.withColumns(change), ["time", "latitude", "longitude", *existing(grid, MEMBER)], "isobaricInhPa", levels, ("z", "t", "q", "u", "v", "w"))
    return frame.daily(wide, ["latitude", "longitude"], "time", [f"{v}_{x}" for x in levels for v in ("z", "t", "q", "u", "v", "w")])


def silver(bronze: DataFrame, single: DataFrame, pressure: DataFrame, start: str, end: str) -> DataFrame:
    """Dense station-days with grid values, imputed, at four decimals. Rain is never imputed."""
    obs = observations(bronze)
    place = obs.groupBy("STATION").agg(*[frame.first_valid(c, "time").alias(c) for c in ("LATITUDE", "LONGITUDE", "ELEVATION")])
    validate.check(place, {"station_has_place": F.col("LATITUDE").isNotNull() & F.col("LONGITUDE").isNotNull() & F.col("ELEVATION").isNotNull()})
    days = frame.dense(obs.drop("LATITUDE", "LONGITUDE", "ELEVATION"), "STATION", "time", start, end)
    df = joins.cells_of(joins.with_metadata(days, place, ["STATION"]), "LATITUDE", "LONGITUDE")

    def keyed(grid: DataFrame) -> DataFrame:
        cells = {c: F.rint(F.col(c).cast("double") * 100) / 100 for c in ("latitude", "longitude")}
        rounded = {f.name: expr.float_as_written(expr.round4_float(F.col(f.name))) for f in grid.schema if f.dataType.simpleString() == "float" and f.name not in cells}
        return grid.withColumns(cells | rounded | {"time": F.to_date("time")})

    single, pressure = keyed(single), keyed(pressure)
    df = joins.with_grid(df, single)
    w = win.by(["STATION"], "time")
    df = df.withColumns({c: win.carried_both(c, w) for c in existing(df, STATIONARY)})
    df = df.withColumns(impute.filled_from({c: g for c, g in (("TEMP", "t2m"), ("DEWP", "d2m"), ("SLP", "msl"), ("STP", "sp")) if g in df.columns}))
    df = df.withColumn("WDSP", F.coalesce("WDSP", expr.norm(F.col("u10"), F.col("v10"))))
    df = impute.cascade(df, "VISIB", "STATION", F.month("time"), "time").drop(*SUPPORT)
    if left := existing(df, SUPPORT):
        raise validate.Violation(f"support columns left: {left}")
    df = joins.with_grid(df, pressure).drop(*joins.CELL)
    numbers = [f.name for f in df.schema if f.dataType.simpleString() == "double"]
    return df.withColumns({c: expr.round4(F.col(c)) for c in numbers})


def watched_gold(bronze: DataFrame, single: DataFrame, pressure: DataFrame, start: str, end: str, audit: validate.Audit) -> DataFrame:
    """The plan of the gold table, whose checks ``audit`` will have when an action has run: times that can't be read,
    absent levels, targets that don't follow from rain, and (up to a tenth of the rows a warning) inverted temperatures."""
    read = lambda grid, name: audit.watch(grid, name, {"time_is_read": F.col("time").try_cast("timestamp_ntz").isNotNull()})
    grids = single_daily(read(single, "single")), pressure_daily(read(pressure, "grid"), audit=audit)
    out = features.gold(silver(bronze, *grids, start, end))
    rain = F.col("PRCP")
    rules = {name: rain.isNull() | rule for name, rule in validate.gold_rules().items()}
    rules["levels_in_order"] = F.col("z_500").isNull() | F.col("z_850").isNull() | (F.col("z_500") > F.col("z_850"))
    rules["colder_above"] = F.col("t_500").isNull() | F.col("t_850").isNull() | (F.col("t_850") > F.col("t_500"))
    return audit.watch(out, "gold", rules, {"levels_in_order": 0.01, "colder_above": 0.1})


def gold(bronze: DataFrame, single: DataFrame, pressure: DataFrame, start: str, end: str) -> DataFrame:
    """The gold table, computed and written once to the shared folder; an error if a check that was counted meanwhile failed."""
    audit = validate.Audit()
    out, uri = store.written(watched_gold(bronze, single, pressure, start, end, audit), "gold")
    try:
        audit.settle()
    except validate.Violation:
        store.removed(out.sparkSession, uri)
        raise
    return out
