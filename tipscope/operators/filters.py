"""Row filters.

Plain predicates are left to Catalyst, which pushes them to the parquet
scan; statistic-dependent filters join a one-row aggregate.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipscope.functions.features import is_finite
from tipscope.functions.sizing import broadcast_if_small
from tipscope.operators.quantiles import quantile_row

# Lookup is small by definition (one row per taxi zone)
MAX_ZONE_ROWS = 100_000


def zone_ids(zones: DataFrame, boroughs: Sequence[str]) -> DataFrame:
    """Location ids whose borough is in ``boroughs`` (the reference's id list)."""
    ids = (zones.where(F.col("Borough").isin(list(boroughs)))
                .select(F.col("LocationID").alias("_zone_id")).distinct())
    return broadcast_if_small(ids, MAX_ZONE_ROWS)


def borough(trips: DataFrame, zones: DataFrame, boroughs: Sequence[str],
            pu_col: str = "PULocationID", do_col: str = "DOLocationID") -> DataFrame:
    """Keep trips whose pickup and dropoff zones are both in ``boroughs`` (flt_borough).

    Two left-semi joins against the (size-checked, broadcast) id list: no
    shuffle of the trip table, and trips in zones absent from the lookup
    never match (NULL borough never passes).
    """
    ids = zone_ids(zones, boroughs)
    out = trips.join(ids, trips[pu_col] == ids["_zone_id"], "left_semi")
    return out.join(ids, out[do_col] == ids["_zone_id"], "left_semi")


def borough_one(trips: DataFrame, zones: DataFrame, name: str) -> DataFrame:
    """Single-borough variant (flt_borough_one)."""
    return borough(trips, zones, [name])


def trip_quality(df: DataFrame, rules: str = "final") -> DataFrame:
    """Card payment, positive fare (and total), distinct ends, one passenger,
    no airport fee (flt_trip_quality; rules='draft' omits the total test)."""
    cond = ((F.col("payment_type") == 1)
            & (F.col("fare_amount") > 0)
            & (F.col("tpep_pickup_datetime") != F.col("tpep_dropoff_datetime"))
            & (F.col("passenger_count") == 1)
            & (F.col("airport_fee") == 0))
    if rules == "final":
        cond = cond & (F.col("total_amount") > 0)
    elif rules != "draft":
        raise ValueError(f"unknown rule set {rules!r}")
    return df.where(cond)


def model_clean(df: DataFrame, tip: str = "tip_amount", q: float = 0.99,
                minutes: str = "trip_minutes", distance: str = "trip_distance",
                exact: bool = True) -> DataFrame:
    """tip > 0, tip < p99(tip), distance > 0, minutes > 0 (flt_model_clean).

    The quantile is taken over the *input* rows (zero tips included, T2);
    it is a one-row aggregate cross-joined back, so no extra shuffle of
    the trips.
    """
    p = (F.percentile(F.col(tip), F.lit(q)) if exact
         else F.percentile_approx(F.col(tip), F.lit(q), F.lit(10000)))
    thr = df.agg(p.alias("_tip_q"))
    return (df.crossJoin(F.broadcast(thr))
              .where((F.col(tip) > 0) & (F.col(tip) < F.col("_tip_q"))
                     & (F.col(distance) > 0) & (F.col(minutes) > 0))
              .drop("_tip_q"))


def band_trim(df: DataFrame, cols: Iterable[str], lo: float = 0.01, hi: float = 0.99,
              exact: bool = True) -> DataFrame:
    """Keep rows with p_lo <= x <= p_hi on every column at once (flt_band_trim).

    The bands are exact quantiles computed with bounded memory for all
    columns together (one one-row table, cross-joined back)."""
    cols = list(cols)
    if exact:
        bands = quantile_row(df, cols, [lo, hi])
    else:
        bands = df.agg(*[F.percentile_approx(F.col(c), F.lit(p), F.lit(10000)).cast("double")
                         .alias(f"{c}__q{i}") for c in cols for i, p in enumerate((lo, hi))])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).between(F.col(f"{c}__q0"), F.col(f"{c}__q1"))
    return (df.crossJoin(F.broadcast(bands)).where(cond)
              .drop(*[f"{c}__q{i}" for c in cols for i in range(2)]))


def outlier_or(df: DataFrame, fare_gt: float = 65, tip_gt: float = 20) -> DataFrame:
    """fare > 65 or tip > 20 (flt_outlier_or)."""
    return df.where((F.col("fare_amount") > fare_gt) | (F.col("tip_amount") > tip_gt))


def plot_valid(df: DataFrame, cols: Sequence[str], positive: str | None = "fare_amount") -> DataFrame:
    """Non-null, finite values in ``cols`` and a positive ``positive`` column (flt_plot_valid)."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & is_finite(c)
    if positive:
        cond = cond & (F.col(positive) > 0)
    return df.where(cond)


def null_rows(df: DataFrame, col: str) -> DataFrame:
    """Rows where ``col`` is NULL (flt_null_rows)."""
    return df.where(F.col(col).isNull())


def inf_rows(df: DataFrame, minutes: str = "trip_minutes", distance: str = "trip_distance") -> DataFrame:
    """Rows whose speed would be infinite: zero minutes with distance > 0 (flt_inf_rows, T4)."""
    return df.where((F.col(minutes) == 0) & (F.col(distance) > 0))


def dashboard(df: DataFrame, months: Sequence, weekdays: Sequence,
              month_col: str = "month", weekday_col: str = "pickup_weekday_name") -> DataFrame:
    """Month set and weekday set; an empty set selects nothing (flt_dashboard)."""
    if not months or not weekdays:
        return df.where(F.lit(False))
    return df.where(F.col(month_col).isin(list(months)) & F.col(weekday_col).isin(list(weekdays)))


def pair_not_null(df: DataFrame, x: str, y: str) -> DataFrame:
    """Both plotted variables present (flt_pair_not_null)."""
    return df.dropna(subset=[x, y])


def log_positive(df: DataFrame, x: str, y: str, log_x: bool, log_y: bool) -> DataFrame:
    """Keep x > 0 / y > 0 when that axis is on a log scale (flt_log_positive)."""
    cond = F.lit(True)
    if log_x:
        cond = cond & (F.col(x) > 0)
    if log_y:
        cond = cond & (F.col(y) > 0)
    return df.where(cond)


def table_search(df: DataFrame, term: str) -> DataFrame:
    """Rows with ``term`` in any column's text, case aside (flt_table_search). A
    match lies within one column."""
    hay = F.lower(F.concat_ws("\x1f", *[F.col(f"`{c}`").cast("string") for c in df.columns]))
    return df.where(hay.contains(term.lower()))


def where(df: DataFrame, cond: Column) -> DataFrame:
    return df.where(cond)
