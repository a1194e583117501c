"""Declared schemas of the layers. Identifiers are text, days are dates, 6-hourly times have no zone."""

from __future__ import annotations

BRONZE = "STATION string, DATE string, LATITUDE double, LONGITUDE double, ELEVATION double, TEMP string, DEWP string, PRCP string, WDSP string, STP string, SLP string, VISIB string, station_name string, source_year int, source_url string"
SINGLE_GRID = "time timestamp_ntz, latitude float, longitude float, t2m float, d2m float, sst float, u10 float, v10 float, sp float, msl float, z float, lsm float"
PRESSURE_GRID = "time timestamp_ntz, latitude float, longitude float, isobaricInhPa int, z float, t float, q float, u float, v float, w float"
#: Observations used from bronze, and the marks of missing values, fixed.
OBSERVED = ("TEMP", "DEWP", "PRCP", "WDSP", "STP", "SLP", "VISIB")
MARKS = {"TEMP": 9999.9, "DEWP": 9999.9, "PRCP": 99.99, "WDSP": 999.9, "STP": 9999.9, "SLP": 9999.9, "VISIB": 999.9}
UNITS = {"TEMP": "fahrenheit", "DEWP": "fahrenheit", "PRCP": "inch", "WDSP": "knot", "VISIB": "mile"}
PRESSURE_RANGE = (800.0, 1100.0)
LEVELS = (500, 850)
