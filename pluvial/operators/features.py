"""Derived features of the station-day table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pluvial.functions.columns import existing
from pluvial.functions.expr import cycle, norm, ratio

from . import impute
from . import windows as win

#: Column lists, fixed names.
LAGGED = ("u_850", "v_850", "TEMP", "DEWP", "SLP", "VISIB", "dew_point_depression", "moisture_flux_850")
AVERAGED = ("moist_convection_850", "dew_point_depression", "moisture_flux_850", "TEMP", "DEWP", "SLP", "VISIB")
RAIN_MM, YEAR_DAYS = 0.1, 365


def _has(df: DataFrame, *names: str) -> bool:
    return len(existing(df, names)) == len(names)


def seasonal(df: DataFrame, time: str = "time") -> DataFrame:
    day_sin, day_cos = cycle(F.dayofyear(time), YEAR_DAYS)
    month_sin, month_cos = cycle(F.month(time), 12)
    return df.withColumns({"day_sin": day_sin, "day_cos": day_cos, "month_sin": month_sin, "month_cos": month_cos})


def physical(df: DataFrame) -> DataFrame:
    """Thermodynamic, dynamic, geometric and flux features whose inputs exist."""
    col, made = F.col, {}
    for level in (500, 850):
        if _has(df, f"q_{level}", f"w_{level}"):
            made[f"moist_convection_{level}"] = col(f"q_{level}") * col(f"w_{level}")
    if _has(df, "t_850", "t_500", "z_500", "z_850"):
        made["lapse_rate_850_500"] = ratio(col("t_850") - col("t_500"), col("z_500") - col("z_850"))
    if _has(df, "TEMP", "DEWP"):
        made["dew_point_depression"] = col("TEMP") - col("DEWP")
    if _has(df, "u_500", "u_850", "v_500", "v_850"):
        du, dv = col("u_850") - col("u_500"), col("v_850") - col("v_500")
        made |= {"du_850_500": du, "dv_850_500": dv, "wind_shear_mag": norm(du, dv)}
    if _has(df, "z_500", "z_850"):
        made["thickness_500_850"] = col("z_500") - col("z_850")
    if _has(df, "ELEVATION", "z"):
        made["elevation_diff"] = col("ELEVATION") - col("z")
    if _has(df, "q_850", "u_850", "v_850"):
        made["moisture_flux_850"] = col("q_850") * norm(col("u_850"), col("v_850"))
    return df.withColumns(made) if made else df


def tendencies(df: DataFrame, station: str = "STATION", time: str = "time") -> DataFrame:
    if not _has(df, "u_850", "v_850"):
        return df
    w = win.by([station], time)
    df = df.withColumns({"du_dt_850": win.diff("u_850", w), "dv_dt_850": win.diff("v_850", w)})
    return df.withColumn("ageostrophic_signal", norm(F.col("du_dt_850"), F.col("dv_dt_850")))


def history(df: DataFrame, station: str = "STATION", time: str = "time", rain: str = "PRCP", proxy: str = "PRCP_impute") -> DataFrame:
    """Lags of 1 and 2 rows, and means and sums of the 3 rows before. One exchange on the station serves all."""
    w = win.by([station], time)
    source = F.coalesce(F.col(rain), F.col(proxy)) if proxy in df.columns else F.col(rain)
    df = df.withColumn("_rain", source)
    made: dict[str, Column] = {}
    for k in (1, 2):
        made[f"{rain}_lag_{k}"] = win.lag("_rain", w, k)
        made |= {f"{c}_lag_{k}": win.lag(c, w, k) for c in existing(df, LAGGED)}
    made |= {f"{c}_3d_mean": win.past_mean(F.col(c), w) for c in existing(df, AVERAGED)}
    if _has(df, "moisture_flux_850"):
        made["moisture_flux_3d_sum"] = win.past_sum(F.col("moisture_flux_850"), w)
    made |= {f"{rain}_past_3d_mean": win.past_mean(F.col("_rain"), w), f"{rain}_past_3d_sum": win.past_sum(F.col("_rain"), w)}
    return df.withColumns(made).drop("_rain")


def targets(df: DataFrame, rain: str = "PRCP", clip: bool = False) -> DataFrame:
    """Amount, rain label and log amount; null where rain is. ``clip``: negative amounts count as 0."""
    amount = F.when(F.col(rain).isNotNull(), F.greatest(F.col(rain), F.lit(0.0))) if clip else F.col(rain)
    return df.withColumns({"target_1stage_prcp_mm": amount, "target_stage1_rain_label": (amount >= RAIN_MM).cast("int"), "target_stage2_prcp_log1p": F.log1p(amount)})


def gold(silver: DataFrame, station: str = "STATION", time: str = "time") -> DataFrame:
    """All features of a dense silver table."""
    out = tendencies(physical(seasonal(silver, time)), station, time)
    out = impute.past_proxy(out, "PRCP", station, F.month(time), time, "PRCP_impute")
    return targets(history(out, station, time))
