"""Feature table (flow_features) and dashboard extract columns.

Chained projections over the trip table; Catalyst collapses them into one
Project inside the scan's codegen stage. ``month`` is derived first and
the season uses that new month (trap T8).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.functions import features as fx

EXTRACT_DROP = ("pickup_time", "dropoff_time", "pickup_hour", "dropoff_hour",
                "pickup_date", "dropoff_date", "pickup_weekday_num", "dropoff_weekday_num")


def add_features(df: DataFrame, season_months=fx.SEASON_MONTHS,
                 pickup: str = "tpep_pickup_datetime",
                 dropoff: str = "tpep_dropoff_datetime",
                 tip_scale: float = 100.0, tip_guard: bool = False,
                 tip_cap: bool = False) -> DataFrame:
    """All derived columns of the final notebook, in its order."""
    out = df.withColumn("month", F.month(pickup))
    out = out.withColumn("tourist_season", fx.season_flag("month", season_months))
    out = out.withColumns({
        "pickup_time": F.col(pickup),
        "dropoff_time": F.col(dropoff),
    })
    out = out.withColumns({
        "pickup_hour": F.hour("pickup_time"),
        "dropoff_hour": F.hour("dropoff_time"),
        "pickup_date": F.to_date("pickup_time"),
        "dropoff_date": F.to_date("dropoff_time"),
        "pickup_weekday_num": fx.weekday_num("pickup_time"),
        "dropoff_weekday_num": fx.weekday_num("dropoff_time"),
        "pickup_weekday_name": fx.weekday_name("pickup_time"),
        "dropoff_weekday_name": fx.weekday_name("dropoff_time"),
        "trip_minutes": fx.minutes_between("pickup_time", "dropoff_time"),
    })
    out = out.withColumn("trip_speed_mph", fx.speed_mph("trip_distance", "trip_minutes"))
    out = out.withColumn("tip_pct", fx.tip_pct("tip_amount", "fare_amount", scale=tip_scale,
                                               guard=tip_guard, cap=tip_cap))
    return out


def extract_columns(features: DataFrame) -> DataFrame:
    """Feature table minus the eight helper columns (proj_drop / flow_extract)."""
    return features.drop(*EXTRACT_DROP)


def unit_rates(df: DataFrame) -> DataFrame:
    """Fare and tip per mile and per minute (ft_unit_rates)."""
    return df.withColumns({
        "fare_per_mile": fx.unit_rate("fare_amount", "trip_distance"),
        "fare_per_minute": fx.unit_rate("fare_amount", "trip_minutes"),
        "tip_per_mile": fx.unit_rate("tip_amount", "trip_distance"),
        "tip_per_minute": fx.unit_rate("tip_amount", "trip_minutes"),
    })
