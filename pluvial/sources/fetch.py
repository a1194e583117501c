"""Remote sources: yearly station files over HTTP, and requests for reanalysis fields."""

from __future__ import annotations

import csv
import io
import logging
import os
import time
import urllib.request
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .schemas import BRONZE, LEVELS, OBSERVED

log = logging.getLogger(__name__)
#: Requests, fixed values.
AREA = [24, 102, 8, 110]  # north, west, south, east
HOURS = ["00:00", "06:00", "12:00", "18:00"]
SINGLE_VARIABLES = ["2m_temperature", "2m_dewpoint_temperature", "sea_surface_temperature", "10m_u_component_of_wind", "10m_v_component_of_wind", "surface_pressure", "mean_sea_level_pressure", "geopotential"]
PRESSURE_VARIABLES = ["geopotential", "temperature", "specific_humidity", "u_component_of_wind", "v_component_of_wind", "vertical_velocity"]


def reanalysis_request(year: int, variables: Sequence[str], levels: Sequence[int] = ()) -> dict:
    """What to ask a reanalysis archive for: one year, all days, four times a day, the area."""
    request = {
        "product_type": ["reanalysis"], "variable": list(variables), "year": [str(year)], "month": [f"{m:02d}" for m in range(1, 13)],
        "day": [f"{d:02d}" for d in range(1, 32)], "time": HOURS, "area": AREA, "data_format": "grib",
    }
    return request | ({"pressure_level": [str(x) for x in levels]} if levels else {})


def single_level_request(year: int) -> dict:
    return reanalysis_request(year, SINGLE_VARIABLES)


def pressure_level_request(year: int) -> dict:
    return reanalysis_request(year, PRESSURE_VARIABLES, LEVELS)


def land_yearly(years: Sequence[int], path_of: Callable[[int], str], retrieve: Callable[[int, str], None]) -> list[str]:
    """Calls ``retrieve(year, path)`` for the years whose file is absent or empty; a part file never passes for a whole one."""
    out = []
    for y in years:
        path = path_of(y)
        if not (os.path.exists(path) and os.path.getsize(path)):
            retrieve(y, path + ".part")
            os.replace(path + ".part", path)
        out.append(path)
    return out


class _StationYear(InputPartition):
    def __init__(self, station: str, name: str, year: int, url: str):
        super().__init__(f"{station}/{year}")
        self.station, self.name, self.year, self.url = station, name, year, url


def parse_station_csv(text: str, part) -> list[tuple]:
    """Rows of one station-year in the order of the bronze schema."""
    rows = []
    number = lambda r, c: float(r[c]) if (r.get(c) or "").strip() else None
    for r in csv.DictReader(io.StringIO(text)):
        r = {(k or "").strip(): v for k, v in r.items()}
        head = (r.get("STATION") or part.station, r.get("DATE"), *(number(r, c) for c in ("LATITUDE", "LONGITUDE", "ELEVATION")))
        observed = {c: (r.get(c) or "").strip() or None for c in OBSERVED}
        rows.append((*head, *(observed[c] for c in ("TEMP", "DEWP", "PRCP", "WDSP", "STP", "SLP", "VISIB")), part.name, part.year, part.url))
    return rows


class StationYears(DataSource):
    """``spark.read.format("station_years")`` with options ``url`` (a pattern with {station} and {year}),
    ``stations`` (id=name, by commas), ``first_year``, ``last_year``, ``timeout`` and ``pause`` in seconds.

    One partition for each station and year. A file that can't be fetched is
    logged and gives no rows.
    """

    @classmethod
    def name(cls) -> str:
        return "station_years"

    def schema(self) -> str:
        return BRONZE

    def reader(self, schema) -> DataSourceReader:
        return _StationReader(self.options)


class _StationReader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        stations = [s.split("=", 1) for s in self.options["stations"].split(",")]
        years = range(int(self.options["first_year"]), int(self.options["last_year"]) + 1)
        return [_StationYear(s[0], s[-1], y, self.options["url"].format(station=s[0], year=y)) for s in stations for y in years]

    def read(self, partition):
        try:
            with urllib.request.urlopen(partition.url, timeout=float(self.options.get("timeout", 15))) as r:
                text = r.read().decode("utf-8")
        except OSError as e:
            log.warning("%s: %s", partition.url, e)
            return
        yield from parse_station_csv(text, partition)
        time.sleep(float(self.options.get("pause", 0.2)))


def station_years(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(StationYears)
    return spark.read.format("station_years").options(**{k: str(v) for k, v in options.items()}).load()
