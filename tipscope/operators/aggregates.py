"""Grouped statistics.

Every function is one ``groupBy().agg()`` (partial aggregation map-side,
one shuffle on the group key) or a global ``agg`` (no shuffle of rows).
Exact medians use ``percentile``, whose partial state is a value->count
map: for cent-quantised money it stays small even for a hot group.
``exact=False`` switches to ``percentile_approx`` for continuous columns.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipscope.functions import features as fx
from tipscope.operators.quantiles import exact_quantiles

# Labels of the season chart
SEASON_WORDS = ("Tourist Season", "Non-Tourist Season")


def _median(c: str, exact: bool = True) -> Column:
    return (F.percentile(F.col(c), F.lit(0.5)) if exact
            else F.percentile_approx(F.col(c), F.lit(0.5), F.lit(10000)).cast("double"))


def _q(c: str, q: float, exact: bool = True) -> Column:
    return (F.percentile(F.col(c), F.lit(q)) if exact
            else F.percentile_approx(F.col(c), F.lit(q), F.lit(10000)).cast("double"))


def row_count(df: DataFrame) -> DataFrame:
    """Rows in a table (agg_row_count)."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def count_by(df: DataFrame, *cols: str) -> DataFrame:
    """Rows per key (agg_count_by, smp_check)."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def value_table(df: DataFrame, col: str) -> DataFrame:
    """Frequency table without NULLs (agg_value_table; R ``table`` drops NA)."""
    return df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def tip_summary(df: DataFrame, exact: bool = True) -> DataFrame:
    """Mean and median of tip and tip % (agg_tip_summary). The tip median
    uses the value->count map (cent-quantised); the tip-share median is a
    continuous column, so it is computed exactly with bounded memory."""
    main = df.agg(F.avg("tip_amount").alias("mean_tip"),
                  _median("tip_amount", exact).alias("median_tip"),
                  F.avg("tip_pct").alias("mean_tip_pct"))
    if exact:
        med = exact_quantiles(df, "tip_pct", [0.5], names=["median_tip_pct"])
    else:
        med = df.agg(_median("tip_pct", False).alias("median_tip_pct"))
    # left join on a constant: an input without any tip share still gives one row
    return (main.join(F.broadcast(med), F.lit(True), "left")
                .select("mean_tip", "median_tip", "mean_tip_pct", "median_tip_pct"))


def hourly(df: DataFrame, exact: bool = True) -> DataFrame:
    """Median and mean tip per pickup hour (agg_hourly)."""
    return df.groupBy("pickup_hour").agg(_median("tip_amount", exact).alias("median_tip"),
                                         F.avg("tip_amount").alias("avg_tip"))


def weekday_median(df: DataFrame, exact: bool = True) -> DataFrame:
    """Median tip per pickup weekday (agg_weekday_median)."""
    return df.groupBy("pickup_weekday_name").agg(_median("tip_amount", exact).alias("median_tip"))


def monthly(df: DataFrame) -> DataFrame:
    """Mean tip per month (agg_monthly)."""
    return df.groupBy("month").agg(F.avg("tip_amount").alias("avg_tip_amt"))


def month_season(df: DataFrame, months=fx.SEASON_MONTHS_CHART) -> DataFrame:
    """Mean tip per (month name, season word); the chart counts August in season
    (agg_month_season, trap T9)."""
    # the season is a function of the month, so grouping by month alone is enough
    season = F.when(F.col("month_num").isin(list(months)), F.lit(SEASON_WORDS[0])) \
              .otherwise(F.lit(SEASON_WORDS[1]))
    return (df.groupBy(F.col("month").alias("month_num"))
              .agg(F.avg("tip_amount").alias("avg_tip_amt"))
              .select(fx.month_name("month_num").alias("month"), "month_num",
                      season.alias("tourist_season"), "avg_tip_amt"))


def season(df: DataFrame) -> DataFrame:
    """Mean tip per season flag (agg_season)."""
    return df.groupBy("tourist_season").agg(F.avg("tip_amount").alias("avg_tip_amt"))


def payment_tip_pct(df: DataFrame) -> DataFrame:
    """Mean guarded tip fraction per payment type (agg_payment_tip_pct)."""
    frac = fx.tip_pct("tip_amount", "fare_amount", scale=1, guard=True)
    return df.groupBy("payment_type").agg(F.avg(frac).alias("avg_tip_pct"))


def bar_count(df: DataFrame, x: str, levels: Sequence | None = None) -> DataFrame:
    """Count by one category, with its level rank for ordering (agg_bar_count)."""
    out = df.groupBy(x).agg(F.count(F.lit(1)).alias("n"))
    if levels is not None:
        out = out.withColumn("level", fx.level_rank(x, levels)).orderBy("level", x)
    return out


def bar_count_fill(df: DataFrame, x: str, fill: str) -> DataFrame:
    """Count by two categories (agg_bar_count_fill)."""
    return df.groupBy(x, fill).agg(F.count(F.lit(1)).alias("n"))


def borough_compare(df: DataFrame, borough_col: str = "PUBorough", exact: bool = True) -> DataFrame:
    """Tip distribution and zero-tip share per borough (agg_borough_compare)."""
    return df.groupBy(borough_col).agg(
        F.count(F.lit(1)).alias("n"),
        _q("tip_amount", 0.25, exact).alias("tip_q1"),
        _q("tip_amount", 0.5, exact).alias("tip_median"),
        _q("tip_amount", 0.75, exact).alias("tip_q3"),
        F.avg("tip_amount").alias("tip_mean"),
        F.avg((F.col("tip_amount") == 0).cast("double")).alias("zero_tip_share"))


def cond_count(df: DataFrame, cond: Column, name: str = "n") -> DataFrame:
    """Rows meeting a condition, NULL counted as not met (agg_cond_count)."""
    return df.agg(F.count_if(F.coalesce(cond, F.lit(False))).alias(name))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Null count per named column, one pass (agg_null_counts)."""
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in cols])


def quantile(df: DataFrame, col: str, q: float, exact: bool = True, name: str = "q") -> DataFrame:
    """One quantile, R type 7 / linear (agg_quantile, trap T3)."""
    return df.agg(_q(col, q, exact).alias(name))


def minmax(df: DataFrame, col: str) -> DataFrame:
    """Range of a column (agg_minmax)."""
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"))


def choices(df: DataFrame, col: str, levels: Sequence | None = None) -> DataFrame:
    """Distinct values in level order, for filter inputs (agg_choices)."""
    out = df.select(col).where(F.col(col).isNotNull()).distinct()
    if levels is not None:
        return out.withColumn("level", fx.level_rank(col, levels)).orderBy("level")
    return out.orderBy(col)


def unique(df: DataFrame, col: str) -> DataFrame:
    """Distinct values of a column (prof_unique)."""
    return df.select(col).distinct()


def duration_quality(df: DataFrame, pickup: str = "tpep_pickup_datetime",
                     dropoff: str = "tpep_dropoff_datetime",
                     minutes: str = "trip_minutes") -> DataFrame:
    """Anomaly report: minutes <= 0, NULL minutes, NULL ends, exact-midnight
    ends, zero duration (qual_duration). One global aggregate."""
    def midnight(c):  # time-zone free: the day start of a zone-less timestamp
        return F.to_date(F.col(c)).cast("timestamp_ntz") == F.col(c)
    return df.agg(
        F.count_if(F.col(minutes) <= 0).alias("minutes_le_0"),
        F.count_if(F.col(minutes).isNull()).alias("minutes_null"),
        F.count_if(F.col(pickup).isNull()).alias("pickup_null"),
        F.count_if(F.col(dropoff).isNull()).alias("dropoff_null"),
        F.count_if(midnight(pickup)).alias("pickup_midnight"),
        F.count_if(midnight(dropoff)).alias("dropoff_midnight"),
        F.count_if(F.col(minutes) == 0).alias("minutes_eq_0"),
    )


def total_reconciliation(df: DataFrame, parts: Sequence[str], total: str = "total_amount",
                         tol: float = 0.005) -> DataFrame:
    """Recompute the total from its parts and count mismatches (qual_total_recon)."""
    recon = F.lit(0.0)
    for p in parts:
        recon = recon + F.coalesce(F.col(p), F.lit(0.0))
    diff = F.abs(F.col(total) - recon)
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.count_if(diff > tol).alias("n_mismatch"),
                  F.max(diff).alias("max_abs_diff"))
