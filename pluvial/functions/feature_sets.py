"""Lists of model features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from .columns import chosen, numeric_columns

# Columns that are no features, in evaluation and in the dashboard.
NO_FEATURES = ("STATION", "time", "PRCP", "target_1stage_prcp_mm", "target_stage1_rain_label", "target_stage2_prcp_log1p", "PRCP_impute")
NO_FEATURES_DASHBOARD = (
    "PRCP", "PRCP_log1p", "PRCP_impute", "target_1stage_prcp_mm", "target_stage1_rain_label", "target_stage2_prcp_log1p",
    "STATION", "NAME", "DATE", "date", "time", "datetime", "year", "month", "day", "day_of_year",
)

# The selected features of the evaluation.
SELECTED = (
    "dew_point_depression", "VISIB_lag_1", "VISIB", "TEMP", "moist_convection_850_3d_mean", "DEWP_lag_1", "VISIB_3d_mean", "TEMP_lag_2",
    "v10", "u10", "q_500", "moisture_flux_850", "dv_850_500", "DEWP", "dew_point_depression_lag_2", "dew_point_depression_lag_1",
    "TEMP_lag_1", "q_850", "PRCP_lag_1", "u_850", "day_sin", "day_cos", "thickness_500_850", "ageostrophic_signal", "dv_dt_850",
    "lapse_rate_850_500", "moist_convection_850", "z_500", "t_850", "wind_shear_mag", "t_500", "moisture_flux_850_lag_1", "w_850",
    "DEWP_3d_mean", "w_500", "v_850_lag_1", "STP", "du_dt_850", "du_850_500", "SLP_lag_2", "VISIB_lag_2", "moisture_flux_850_lag_2",
    "LATITUDE", "LONGITUDE", "u_500", "u_850_lag_1",
)

# The dashboard's own selection; some names exist in no table.
SELECTED_DASHBOARD = (
    "LATITUDE", "LONGITUDE", "ELEVATION", "latitude", "longitude", "elevation", "TEMP", "DEWP", "SLP", "STP", "WDSP", "VISIB",
    "t2m", "d2m", "sp", "msl", "u10", "v10", "z", "lsm", "u_850", "v_850", "q_850", "t_850", "z_850", "w_850", "u_500", "v_500",
    "q_500", "t_500", "z_500", "w_500", "dew_point_depression", "wind_speed_10m", "wind_speed_850", "wind_speed_500", "moisture_flux_850",
    "wind_shear_mag", "thickness_500_850", "lapse_rate_850_500", "ageostrophic_signal", "day_sin", "day_cos", "month_sin", "month_cos",
    "PRCP_lag_1", "PRCP_lag_2", "PRCP_past_3d_mean", "PRCP_past_3d_sum", "TEMP_lag_1", "SLP_lag_1", "VISIB_lag_1", "u_850_lag_1", "v_850_lag_1",
)
LEAST_DASHBOARD, MOST_DASHBOARD = 10, 46


def full(df: DataFrame) -> list[str]:
    return numeric_columns(df, NO_FEATURES)


def selected(df: DataFrame) -> tuple[list[str], list[str]]:
    """The selected features that exist, and those that don't."""
    return chosen(df, SELECTED)


def selected_dashboard(df: DataFrame) -> list[str]:
    """All numeric columns if too few of the dashboard's selection exist."""
    return chosen(df, SELECTED_DASHBOARD, LEAST_DASHBOARD, MOST_DASHBOARD, NO_FEATURES_DASHBOARD)[0]


def sets(df: DataFrame) -> dict[str, Sequence[str]]:
    return {"full": full(df), "selected": selected(df)[0]}
