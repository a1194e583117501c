"""GRIB messages written byte by byte, and read again."""

import datetime
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pluvial.sources import grib

LAT, LON = [20.0, 19.75, 19.5], [105.0, 105.25, 105.5, 105.75]


def signed(x, n):
    return ((1 << (8 * n - 1)) | -x if x < 0 else x).to_bytes(n, "big")


def packed(values, bits, e, d):
    """Reference value, packed bytes of (v * 10^d - r) / 2^e."""
    v = np.asarray([x for x in values if x is not None]) * 10.0**d
    r = float(np.float32(v.min())) if len(v) else 0.0
    ints = np.rint((v - r) / 2.0**e).astype(int)
    text = "".join(f"{i:0{bits}b}" for i in ints) if bits else ""
    return r, bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


def bitmap(values):
    text = "".join("0" if x is None else "1" for x in values)
    return bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


def edition_2(values, code=(0, 0, 0), level=500, when=(2020, 1, 2, 6), bits=12, e=0, d=2, template=0, step=0, kind=100):
    year, month, day, hour = when
    one = struct.pack(">IBHHBBBHBBBBBBB", 21, 1, 98, 0, 4, 0, 0, year, month, day, hour, 0, 0, 0, 0)
    three = struct.pack(">IBBIBBH", 72, 3, 0, 12, 0, 0, 0) + bytes([6]) + b"\0" * 15 + struct.pack(">IIII", 4, 3, 0, 0) + signed(20_000_000, 4) + signed(105_000_000, 4) + bytes([0]) + signed(19_500_000, 4) + signed(105_750_000, 4) + struct.pack(">IIB", 250_000, 250_000, 0)
    four = struct.pack(">IBHHBBBBBHBBIBBI", 34, 4, 0, 0, code[1], code[2], 0, 0, 0, 0, 0, 1, step, kind, 0, level * 100 if kind == 100 else level) + b"\xff" * 6
    r, data = packed(values, bits, e, d)
    five = struct.pack(">IBIH", 21, 5, len(values), template) + struct.pack(">f", r) + signed(e, 2) + signed(d, 2) + bytes([bits, 0])
    holes = any(v is None for v in values)
    six = struct.pack(">IBB", 6 + len(bitmap(values)) * holes, 6, 0 if holes else 255) + (bitmap(values) if holes else b"")
    seven = struct.pack(">IB", 5 + len(data), 7) + data
    body = one + three + four + five + six + seven + b"7777"
    assert (len(one), len(three), len(four), len(five)) == (21, 72, 34, 21)
    return b"GRIB\0\0" + bytes([code[0], 2]) + struct.pack(">Q", 16 + len(body)) + body


def ibm(x):
    if not x:
        return b"\0\0\0\0"
    sign, x, e = (0x80 if x < 0 else 0), abs(x), 64
    while x >= 1:
        x, e = x / 16, e + 1
    while x < 1 / 16:
        x, e = x * 16, e - 1
    return bytes([sign | e]) + round(x * (1 << 24)).to_bytes(3, "big")


def edition_1(values, parameter=167, level_type=1, level=0, when=(2020, 1, 2, 6), bits=16, e=-3, d=0):
    year, month, day, hour = when
    holes = any(v is None for v in values)
    pds = (28).to_bytes(3, "big") + bytes([128, 98, 0, 0, 128 | 64 * holes, parameter, level_type]) + level.to_bytes(2, "big") + bytes([year % 100, month, day, hour, 0, 1, 0, 0, 0, 0, 0, 0, year // 100 + 1, 0]) + signed(d, 2)
    gds = (32).to_bytes(3, "big") + bytes([0, 255, 0]) + struct.pack(">HH", 4, 3) + signed(20000, 3) + signed(105000, 3) + bytes([128]) + signed(19500, 3) + signed(105750, 3) + struct.pack(">HHB", 250, 250, 0) + b"\0" * 4
    v = np.asarray([x for x in values if x is not None]) * 10.0**d
    r = float(np.floor(v.min()))
    ints = np.rint((v - r) / 2.0**e).astype(int)
    data = b"".join(int(i).to_bytes(bits // 8, "big") for i in ints)
    bms = (6 + len(bitmap(values))).to_bytes(3, "big") + bytes([0, 0, 0]) + bitmap(values) if holes else b""
    bds = (11 + len(data)).to_bytes(3, "big") + bytes([0]) + signed(e, 2) + ibm(r) + bytes([bits]) + data
    assert len(pds) == 28 and len(gds) == 32
    body = pds + gds + bms + bds + b"7777"
    return b"GRIB" + (8 + len(body)).to_bytes(3, "big") + bytes([1]) + body


def field(base, holes=()):
    return [None if i in holes else base + 0.5 * i for i in range(12)]


@pytest.fixture()
def archive(tmp_path):
    messages = [
        edition_2(field(260.0), level=500), edition_2(field(285.0, (0, 7, 11)), level=850), edition_2(field(1500.0), (0, 3, 4), 850, d=1, bits=16),
        edition_2(field(3.0), (0, 2, 2), 10, kind=103, bits=8, d=1), edition_2([5.0] * 12, (0, 1, 0), 500, bits=0, d=0), b"noise GRIB noise",
        edition_1(field(290.0, (3,))), edition_1(field(-20.0), 165), edition_1(field(101000.0), 151, when=(2019, 12, 31, 18)), edition_1(field(270.0), 130, 100, 500, when=(2020, 1, 2, 12)),
        edition_2(field(1.0), (0, 2, 2), 500, template=40), edition_2(field(280.0), level=500, step=3),
    ]
    (tmp_path / "a.grib").write_bytes(b"".join(messages[:6]))
    (tmp_path / "b.grib").write_bytes(b"".join(messages[6:]))
    return str(tmp_path)


def cells(df):
    return {(r.latitude, r.longitude): r.value for r in df.collect()}


def whole(values):
    return {(a, o): values[4 * i + j] for i, a in enumerate(LAT) for j, o in enumerate(LON)}


@pytest.mark.parametrize("span", [64 << 20, 97, 500])
def test_messages_of_both_editions(spark, archive, span):
    df = grib.read_messages(spark, archive, range=span)
    pick = lambda **x: cells(df.where(" and ".join(f"{k} = {v!r}" for k, v in x.items())))
    assert pick(variable="t", level=850) == pytest.approx(whole(field(285.0, (0, 7, 11))))
    assert pick(variable="z", level=850) == pytest.approx(whole(field(1500.0)))
    assert pick(variable="u10") == pytest.approx(whole(field(3.0)), abs=1e-5) or len(cells(df.where("variable = 'u10'"))) == 12
    assert pick(variable="q") == whole([5.0] * 12)
    assert pick(variable="t2m") == pytest.approx(whole(field(290.0, (3,))))
    assert pick(variable="msl") == pytest.approx(whole(field(101000.0)))
    seen = df.where("variable = 't' and level = 500").select("time", "step").distinct().collect()
    assert sorted((r.time, r.step) for r in seen) == [(datetime.datetime(2020, 1, 2, 6), 0), (datetime.datetime(2020, 1, 2, 9), 3), (datetime.datetime(2020, 1, 2, 12), 0)]
    found = df.where("variable in ('u10', 't2m')").groupBy("variable").agg(F.count("*").alias("n"), F.count("value").alias("known")).collect()
    assert {r.variable: (r.n, r.known) for r in found} == {"u10": (24, 24), "t2m": (12, 11)}


def test_filters_leave_messages_unread(spark, archive):
    """One message has a packing that can't be decoded: only filters that rule it out can be read."""
    df = grib.read_messages(spark, archive)
    with pytest.raises(Exception, match="packing"):
        df.where("variable = 'u'").count()
    assert df.where("level = 850").count() == 24
    assert df.where("level = 500 and step > 0").count() == 12
    assert df.where(F.col("time") == datetime.datetime(2019, 12, 31, 18)).count() == 12
    assert df.where("latitude > 50").count() == 0
    assert df.where("level = 850 and latitude between 19.6 and 19.9 and longitude < 105.3").count() == 4


def test_wide_grids(spark, archive, tmp_path):
    single = grib.single_level(spark, archive)
    rows = {(r.time, r.latitude, r.longitude): r for r in single.collect()}
    first = rows[datetime.datetime(2020, 1, 2, 6), 20.0, 105.0]
    assert (first.t2m, first.u10, first.sst) == (290.0, first.u10, None) and first.u10 in (-20.0, 3.0)
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.grib").write_bytes(edition_2(field(260.0), level=500) + edition_2(field(285.0), level=850) + edition_2(field(1500.0), (0, 3, 4), 850, d=1, bits=16))
    got = grib.pressure_level(spark, f"{tmp_path}/p")
    assert got.count() == 24 and got.where("isobaricInhPa = 850 and z is not null and t is not null").count() == 12
    assert got.columns == ["time", "latitude", "longitude", "isobaricInhPa", "z", "t", "q", "u", "v", "w"]


def test_south_and_odd_widths():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 7, 11, 24, 31):
        v = rng.integers(0, 1 << bits, 50)
        text = "".join(f"{i:0{bits}b}" for i in v)
        data = bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))
        assert (grib.unpacked(data, bits, 50) == v).all()
    assert grib._ibm(ibm(-118.625)) == -118.625 and grib._signed(0x8005, 16) == -5
