"""Lookup joins.

The zone lookup is a dimension with a size bound (one row per taxi
zone); it is broadcast after a bounded row probe, so the trip table is
never shuffled for these joins. Past the bound Spark falls back to a
shuffle join on the zone id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.functions.sizing import broadcast_if_small, fits
from tipscope.operators.filters import MAX_ZONE_ROWS, borough as _semi_borough


def _lookup(zones: DataFrame, id_name: str, name: str) -> DataFrame:
    z = zones.select(F.col("LocationID").alias(id_name), F.col("Borough").alias(name))
    return broadcast_if_small(z, MAX_ZONE_ROWS)


def left_zone(trips: DataFrame, zones: DataFrame, on: str = "PULocationID",
              name: str = "Borough") -> DataFrame:
    """Left join one zone id to its borough; unmatched ids keep a NULL (join_left_zone)."""
    z = _lookup(zones, "_zid", name)
    return trips.join(z, trips[on] == z["_zid"], "left").drop("_zid")


def left_zone_both(trips: DataFrame, zones: DataFrame, pu: str = "PULocationID",
                   do: str = "DOLocationID") -> DataFrame:
    """Pickup and dropoff boroughs from the same lookup, renamed PU/DO
    (join_left_zone_both, proj_rename)."""
    out = left_zone(trips, zones, pu, "Borough").withColumnRenamed("Borough", "PUBorough")
    return left_zone(out, zones, do, "Borough").withColumnRenamed("Borough", "DOBorough")


def left_zone_suffix(trips: DataFrame, zones: DataFrame, pu: str = "PULocationID",
                     do: str = "DOLocationID") -> DataFrame:
    """The reference's repeated join whose name clash yields ``Borough.x`` /
    ``Borough.y`` (join_suffix); both kept under explicit names."""
    out = left_zone(trips, zones, pu, "Borough.x")
    return left_zone(out, zones, do, "Borough.y")


def semi_zone(trips: DataFrame, zones: DataFrame, boroughs) -> DataFrame:
    """Semi join of both ends against the selected zone ids (join_semi_zone)."""
    return _semi_borough(trips, zones, boroughs)


def scalar(df: DataFrame, stat: DataFrame) -> DataFrame:
    """Attach a one-row statistic to every row (join_scalar). The statistic
    is checked to hold one row before it is broadcast."""
    if not fits(stat, 1):
        raise ValueError("join_scalar expects a one-row statistic")
    return df.crossJoin(F.broadcast(stat))
