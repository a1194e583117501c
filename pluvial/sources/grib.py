"""GRIB files (editions 1 and 2) as rows, without a foreign library.

A file is cut into byte ranges, a partition each; a message belongs to the range
in which it begins. A task reads the headers of its messages, which say the
variable, time, step, level and grid, and skips to the next one where the pushed
filters rule a message out: its values are never read. What is left is decoded
(regular grids, simple packing, bitmaps) into Arrow batches.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from .schemas import LEVELS

#: Bytes of a partition, about; bytes looked through at once for the start of a message.
RANGE, WINDOW = 64 << 20, 1 << 20
SCHEMA = "variable string, time timestamp_ntz, step int, level int, latitude float, longitude float, value float"
# Parameter numbers of edition 1 (table 128), and (discipline, category, number) of edition 2.
NAMES_1 = {129: "z", 130: "t", 131: "u", 132: "v", 133: "q", 134: "sp", 135: "w", 34: "sst", 151: "msl", 165: "u10", 166: "v10", 167: "t2m", 168: "d2m", 172: "lsm"}
NAMES_2 = {(0, 0, 0): "t", (0, 0, 6): "d2m", (0, 1, 0): "q", (0, 2, 2): "u", (0, 2, 3): "v", (0, 2, 8): "w", (0, 3, 0): "sp", (0, 3, 1): "msl", (0, 3, 4): "z", (2, 0, 0): "lsm", (10, 3, 0): "sst"}
NEAR_GROUND = {"t": "t2m", "u": "u10", "v": "v10"}  # at a height above ground
HOURS = {0: 1 / 60, 1: 1, 2: 24, 10: 3, 11: 6, 12: 12}  # by unit of a step
PRESSURE, HEIGHT = 100, {1: 105, 2: 103}  # types of level


def _signed(x: int, bits: int) -> int:
    """Sign and magnitude."""
    top = 1 << (bits - 1)
    return -(x - top) if x & top else x


def _int(b: bytes, a: int, n: int) -> int:
    return int.from_bytes(b[a : a + n], "big")


def _ibm(b: bytes) -> float:
    x = int.from_bytes(b, "big")
    return (-1.0 if x >> 31 else 1.0) * (x & 0xFFFFFF) / (1 << 24) * 16.0 ** (((x >> 24) & 127) - 64)


@dataclass
class Message:
    """What the headers say, and where the values are: (offset, length) in the file."""

    variable: str
    time: datetime
    step: int
    level: int
    shape: tuple[int, int]  # rows of equal latitude, columns
    first: tuple[float, float]
    last: tuple[float, float]
    scan: int
    packing: tuple[float, int, int, int] | None  # reference, binary and decimal scale, bits; None: no simple packing
    bitmap: tuple[int, int] | None
    data: tuple[int, int]

    def axes(self) -> tuple[np.ndarray, np.ndarray]:
        (la, lo), (lb, lp) = self.first, self.last
        if lp < lo and not self.scan & 128:
            lp += 360.0
        lon = np.linspace(lo, lp, self.shape[1])
        return np.linspace(la, lb, self.shape[0]), np.where(lon >= 180.0 + 1e-9, lon - 360.0, lon) if lon.max() > 180 else lon

    def values(self, read) -> np.ndarray:
        """All cells by latitude and longitude; NaN where the bitmap has none. ``read(offset, length)`` gives bytes."""
        if self.packing is None:
            raise ValueError(f"{self.variable}: packing is not supported")
        reference, e, d, bits = self.packing
        n = self.shape[0] * self.shape[1]
        there = np.ones(n, bool)
        if self.bitmap:
            there = np.unpackbits(np.frombuffer(read(*self.bitmap), np.uint8), count=n).astype(bool)
        count = int(there.sum())
        packed = unpacked(read(*self.data), bits, count)
        out = np.full(n, np.nan)
        out[there] = (reference + packed * 2.0**e) * 10.0**-d
        return out.reshape(self.shape[::-1]).T if self.scan & 32 else out.reshape(self.shape)


def unpacked(data: bytes, bits: int, n: int) -> np.ndarray:
    """``n`` whole numbers of ``bits`` each."""
    if bits == 0:
        return np.zeros(n)
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", n).astype(np.float64)
    every = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return every @ (2.0 ** np.arange(bits - 1, -1, -1))


def _edition_1(f, at: int) -> Message:
    f.seek(at + 8)
    pds = f.read(28)
    size, flags = _int(pds, 0, 3), pds[7]
    if not flags & 128:
        raise ValueError("a message without a grid")
    f.seek(at + 8 + size)
    gds = f.read(28)
    if gds[5] != 0:
        raise ValueError(f"grid type {gds[5]} is not supported")
    place = at + 8 + size + _int(gds, 0, 3)
    bitmap = None
    if flags & 64:
        f.seek(place)
        head = f.read(6)
        if _int(head, 4, 2):
            raise ValueError("bitmaps by number are not supported")
        bitmap = (place + 6, _int(head, 0, 3) - 6)
        place += _int(head, 0, 3)
    f.seek(place)
    bds = f.read(11)
    simple = not bds[3] >> 4
    packing = (_ibm(bds[6:10]), _signed(_int(bds, 4, 2), 16), _signed(_int(pds, 26, 2), 16), bds[10]) if simple else None
    year = (pds[24] - 1) * 100 + pds[12]
    name = NAMES_1.get(pds[8], f"p{pds[8]}") if pds[3] == 128 else f"p{pds[3]}.{pds[8]}"
    degrees = lambda a: _signed(_int(gds, a, 3), 24) / 1000
    step = pds[18] if pds[20] != 10 else _int(pds, 18, 2)
    return Message(
        name, datetime(year, *pds[13:15], pds[15], pds[16]), round(step * HOURS[pds[17]]), _int(pds, 10, 2) if pds[9] == PRESSURE else 0, (_int(gds, 8, 2), _int(gds, 6, 2)),
        (degrees(10), degrees(13)), (degrees(17), degrees(20)), gds[27], packing, bitmap, (place + 11, _int(bds, 0, 3) - 11),
    )


def _edition_2(f, at: int, total: int) -> Iterator[Message]:
    """One message for each field; sections 2 to 7 may repeat."""
    f.seek(at)
    discipline, place = f.read(16)[6], at + 16
    time = grid = product = packing = None
    bitmap: tuple[int, int] | None = None
    while place < at + total - 4:
        f.seek(place)
        head = f.read(5)
        size, number = _int(head, 0, 4), head[4]
        body = head + (f.read(min(size, 96) - 5) if number not in (2, 7) else b"")
        if number == 1:
            time = datetime(_int(body, 12, 2), *body[14:19])
        elif number == 3:
            if _int(body, 12, 2):
                raise ValueError(f"grid template {_int(body, 12, 2)} is not supported")
            degrees = lambda a: _signed(_int(body, a, 4), 32) / 1e6  # noqa: B023, E731
            grid = ((_int(body, 34, 4), _int(body, 30, 4)), (degrees(46), degrees(50)), (degrees(55), degrees(59)), body[71])
        elif number == 4:
            name = NAMES_2.get((discipline, body[9], body[10]), f"p{discipline}.{body[9]}.{body[10]}")
            kind, scale, level = body[22], _signed(body[23], 8), _int(body, 24, 4)
            name = NEAR_GROUND.get(name, name) if kind == HEIGHT[2] else name
            product = (name, round(_int(body, 18, 4) * HOURS[body[17]]), round(level / 10.0**scale / 100) if kind == PRESSURE else 0)
        elif number == 5:
            simple = _int(body, 9, 2) == 0
            packing = (struct.unpack(">f", body[11:15])[0], _signed(_int(body, 15, 2), 16), _signed(_int(body, 17, 2), 16), body[19]) if simple else None
        elif number == 6:
            if body[5] not in (0, 254, 255):
                raise ValueError("bitmaps by number are not supported")
            bitmap = (place + 6, size - 6) if body[5] == 0 else None if body[5] == 255 else bitmap
        elif number == 7:
            yield Message(product[0], time, product[1], product[2], *grid, packing, bitmap, (place + 5, size - 5))
        place += size


def index(f, start: int, end: int, size: int) -> Iterator[Message]:
    """Messages that begin in [start, end) of a file of ``size`` bytes, by their headers.

    What looks like a beginning counts if the message that it announces ends as one has to.
    """
    at = start
    while at < end:
        f.seek(at)
        head = f.read(16)
        if head[:4] != b"GRIB":
            f.seek(at)
            found = f.read(WINDOW + 3).find(b"GRIB", 1)
            at = at + found if found > 0 else at + WINDOW
            continue
        total = _int(head, 4, 3) if head[7] == 1 else _int(head, 8, 8) if head[7] == 2 else 0
        f.seek(at + total - 4)
        if not total or at + total > size or f.read(4) != b"7777":
            at += 4
            continue
        if head[7] == 1:
            yield _edition_1(f, at)
        else:
            yield from _edition_2(f, at, total)
        at += total


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(f"{path}:{start}")
        self.path, self.start, self.end = path, start, end


class Grib(DataSource):
    """``spark.read.format("grib_messages")`` with the path of a file, a folder, or several by commas; option ``range``: bytes of a partition.

    Files have to lie where all executors can open them. Filters on ``variable,
    time, step, level`` choose messages by their headers, filters on the
    coordinates leave out messages that lie outside.
    """

    @classmethod
    def name(cls) -> str:
        return "grib_messages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _GribReader(dict(self.options))


_TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class _GribReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.filters = options, []

    def pushFilters(self, filters: list[Filter]):
        for x in filters:
            whole = len(getattr(x, "attribute", ())) == 1
            if whole and type(x) in _TESTS and x.attribute[0] in ("variable", "time", "step", "level", "latitude", "longitude"):
                self.filters.append((x.attribute[0], _TESTS[type(x)], x.value, type(x)))
                if x.attribute[0] in ("variable", "step", "level"):
                    continue  # decided for whole messages
            yield x

    def partitions(self):
        step = int(self.options.get("range", RANGE))
        paths = []
        for p in self.options["path"].removeprefix("file://").split(","):
            paths += sorted(os.path.join(p, x) for x in os.listdir(p) if not x.startswith((".", "_"))) if os.path.isdir(p) else [p]
        return [_Range(p, a, min(a + step, n)) for p in paths for n in [os.path.getsize(p)] for a in range(0, n, step)]

    def _wanted(self, m: Message) -> bool:
        """Whether some cell of the message may pass."""
        for name, test, value, kind in self.filters:
            if name in ("latitude", "longitude"):
                axis = m.axes()[name == "longitude"].astype(np.float32)
                near = {EqualTo: lambda a, v: (a == v).any(), In: lambda a, v: np.isin(a, list(v)).any()}.get(kind, lambda a, v, test=test: test(a, v).any())
                if not near(axis, value):
                    return False
            else:
                value = value.replace(tzinfo=None) if isinstance(value, datetime) else value
                if not test(m.time + timedelta(hours=m.step) if name == "time" else getattr(m, name), value):
                    return False
        return True

    def read(self, partition):
        with open(partition.path, "rb") as f:

            def part(offset: int, length: int) -> bytes:
                f.seek(offset)
                return f.read(length)

            for m in index(f, partition.start, partition.end, os.path.getsize(partition.path)):
                if self._wanted(m):
                    values, (lat, lon) = m.values(part), m.axes()
                    n = values.size
                    same = lambda x, kind, n=n: pa.array([x], kind).take(pa.array(np.zeros(n, np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [
                            same(m.variable, pa.string()), same(m.time + timedelta(hours=m.step), pa.timestamp("us")), same(m.step, pa.int32()), same(m.level, pa.int32()),
                            pa.array(np.repeat(lat, len(lon)).astype(np.float32)), pa.array(np.tile(lon, len(lat)).astype(np.float32)), pa.array(values.ravel().astype(np.float32), from_pandas=True),
                        ],
                        ["variable", "time", "step", "level", "latitude", "longitude", "value"],
                    )


def read_messages(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows of SCHEMA, one for each cell; ``time`` is that of the reference plus the step, ``level`` 0 off pressure levels."""
    spark.dataSource.register(Grib)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("grib_messages").options(**{k: str(v) for k, v in options.items()}).load(path)


def _wide(rows: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    aggs = [F.first(F.when(F.col("variable") == v, F.col("value")), ignorenulls=True).alias(v) for v in variables]
    return rows.where(F.col("variable").isin(list(variables))).groupBy(*keys).agg(*aggs)


def single_level(spark: SparkSession, path: str) -> DataFrame:
    """The single-level grid, a column for each variable; absent ones are null."""
    return _wide(read_messages(spark, path).where("level = 0 and step = 0"), ["time", "latitude", "longitude"], ["t2m", "d2m", "sst", "u10", "v10", "sp", "msl", "z", "lsm"])


def pressure_level(spark: SparkSession, path: str, levels: Sequence[int] = LEVELS) -> DataFrame:
    """The pressure grid in long form by level."""
    rows = read_messages(spark, path).where(F.col("level").isin(list(levels)) & (F.col("step") == 0)).withColumnRenamed("level", "isobaricInhPa")
    return _wide(rows, ["time", "latitude", "longitude", "isobaricInhPa"], ["z", "t", "q", "u", "v", "w"])
