"""Query catalog plumbing: the Query record, shared derived sets and
the register() helper used by the section modules.

Every query reads the given tables (or data Spark derives from them) in
full; doubles are rounded to ``PLACES`` on both sides so that summation
order does not decide equality.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipscope import oracle
from tipscope.operators import filters as flt
from tipscope.plans.features import add_features
from tipscope.sources import files
from tipscope.sources import fixtures as fx_src

PLACES = 6
# The columns of the feature table by family
FRAME_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
FRAME_NUMERIC = ("fare_amount", "tip_amount", "trip_distance", "extra", "payment_type", "passenger_count",
                 "airport_fee", "total_amount", "PULocationID", "DOLocationID", "month", "pickup_hour",
                 "dropoff_hour", "pickup_weekday_num", "dropoff_weekday_num", "trip_minutes",
                 "trip_speed_mph", "tip_pct")
FRAME_STRING = ("file_month", "tourist_season", "pickup_weekday_name", "dropoff_weekday_name")
FRAME_TIME = ("tpep_pickup_datetime", "tpep_dropoff_datetime", "pickup_time", "dropoff_time")
FRAME_DATE = ("pickup_date", "dropoff_date")
FRAME = FRAME_KEY + FRAME_NUMERIC + FRAME_STRING + FRAME_TIME + FRAME_DATE
SELECTED = list(oracle.SELECTED_BOROUGHS)


@dataclass
class Query:
    fn: Callable[[SparkSession, str], DataFrame]
    body: str | None = None           # oracle SQL body (None: rows-only check)
    ctes: tuple = ()
    doubles: tuple = ()               # double columns rounded in the oracle
    extra: dict = field(default_factory=dict)

    def oracle_sql(self) -> str | None:
        if self.body is None:
            return None
        body = self.body
        if self.doubles:
            rep = ", ".join(f"round({c}, {PLACES}) AS {c}" for c in self.doubles)
            body = f"SELECT * REPLACE ({rep}) FROM ({self.body}) _q"
        return oracle.sql(body, *self.ctes, extra=self.extra)


def round_doubles(df: DataFrame, places: int = PLACES) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            # round(x * 10^p) / 10^p: the same double arithmetic as the oracle's round()
            m = F.lit(float(10 ** places))
            cols.append((F.round(F.col(f"`{f.name}`") * m) / m).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


# ---------------------------------------------------------------- shared sets
def trips(spark, sf):
    """The trip table, derived once per application and kept as parquet."""
    return files.materialized(spark, f"trips:{sf}", lambda: fx_src.trips(spark, sf))


def zones(spark, sf):
    return fx_src.zones(spark, sf)


def selected(spark, sf):
    """Trips with both ends in the selected boroughs passing the final rules. Where
    the trip table is not stored yet, they come from its plan: the rules reach the
    scans below the joins, so only rows that pass them are shuffled and none of the
    others is stored."""
    z = zones(spark, sf)
    t = files.held(spark, f"trips:{sf}")
    if t is None:
        t = fx_src.trips(spark, sf, flt.zone_ids(z, SELECTED))
    t = flt.borough(t, z, SELECTED)
    return flt.trip_quality(t, "final")


def analysis(spark, sf):
    """Feature table over the selected trips (the reference's df_final,
    unsampled), materialised once like the notebook's data frame."""
    return files.materialized(spark, f"analysis:{sf}", lambda: add_features(selected(spark, sf)))


def all_features(spark, sf):
    """Features of every trip: projections over the stored trip table,
    recomputed per query (cheaper than storing a second full-size table)."""
    return add_features(trips(spark, sf))


def signif_sql(v, digits=10):
    k = f"(floor(log10(abs({v}))) - {digits - 1})"
    return (f"CASE WHEN {v} = 0 THEN 0.0 WHEN {k} >= 0 THEN round({v} / pow(10.0, {k})) * pow(10.0, {k})"
            f" ELSE round({v} * pow(10.0, -{k})) / pow(10.0, -{k}) END")


REGISTRY: dict[str, Query] = {}


def register(name, fn, body=None, ctes=(), doubles=(), extra=None):
    REGISTRY[name] = Query(fn, body, tuple(ctes), tuple(doubles), extra or {})




def table(spark, sf, name):
    return fx_src.table(spark, sf, name)
