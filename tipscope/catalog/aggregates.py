"""Registered aggregate and profiling queries."""

from pyspark.sql import functions as F

from tipscope.catalog.base import (FRAME, FRAME_DATE, FRAME_KEY, FRAME_NUMERIC, FRAME_STRING, FRAME_TIME, all_features,
                                   analysis, register, signif_sql, trips, zones)
from tipscope.functions.features import WEEKDAY_ABBR_MON_FIRST
from tipscope.operators import aggregates as agg
from tipscope.operators import filters as flt
from tipscope.operators import joins
from tipscope.operators import profile as prof
from tipscope.operators import regression as reg
from tipscope.sources import files

register(
    "agg_hourly",
    lambda s, d: agg.hourly(analysis(s, d)),
    """SELECT pickup_hour, quantile_cont(tip_amount, 0.5) AS median_tip,
              avg(tip_amount) AS avg_tip
       FROM feat GROUP BY pickup_hour""",
    ["feat"], ["median_tip", "avg_tip"])

register(
    "agg_row_count",
    lambda s, d: agg.row_count(trips(s, d)),
    "SELECT count(*) AS n FROM trips", ["trips"])

register(
    "agg_count_by",
    lambda s, d: agg.count_by(analysis(s, d), "file_month"),
    "SELECT file_month, count(*) AS n FROM feat GROUP BY file_month", ["feat"])

register(
    "agg_value_table",
    lambda s, d: agg.value_table(trips(s, d), "passenger_count"),
    """SELECT passenger_count, count(*) AS n FROM trips
       WHERE passenger_count IS NOT NULL GROUP BY passenger_count""", ["trips"])

register(
    "agg_tip_summary",
    lambda s, d: agg.tip_summary(analysis(s, d)),
    """SELECT avg(tip_amount) AS mean_tip, quantile_cont(tip_amount, 0.5) AS median_tip,
              avg(tip_pct) AS mean_tip_pct, quantile_cont(tip_pct, 0.5) AS median_tip_pct
       FROM feat""",
    ["feat"], ["mean_tip", "median_tip", "mean_tip_pct", "median_tip_pct"])

register(
    "agg_weekday_median",
    lambda s, d: agg.weekday_median(analysis(s, d)),
    """SELECT pickup_weekday_name, quantile_cont(tip_amount, 0.5) AS median_tip
       FROM feat GROUP BY pickup_weekday_name""", ["feat"], ["median_tip"])

register(
    "agg_monthly",
    lambda s, d: agg.monthly(analysis(s, d)),
    "SELECT month, avg(tip_amount) AS avg_tip_amt FROM feat GROUP BY month",
    ["feat"], ["avg_tip_amt"])

register(
    "agg_month_season",
    lambda s, d: agg.month_season(analysis(s, d)),
    """SELECT (['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec'])[month]
                AS month,
              month AS month_num,
              CASE WHEN month IN (7, 8, 10, 11, 12) THEN 'Tourist Season'
                   ELSE 'Non-Tourist Season' END AS tourist_season,
              avg(tip_amount) AS avg_tip_amt
       FROM feat GROUP BY month""", ["feat"], ["avg_tip_amt"])

register(
    "agg_season",
    lambda s, d: agg.season(analysis(s, d)),
    "SELECT tourist_season, avg(tip_amount) AS avg_tip_amt FROM feat GROUP BY tourist_season",
    ["feat"], ["avg_tip_amt"])

register(
    "agg_payment_tip_pct",
    lambda s, d: agg.payment_tip_pct(trips(s, d)),
    """SELECT payment_type,
              avg(CASE WHEN fare_amount > 0 THEN tip_amount / nullif(fare_amount, 0) END)
                AS avg_tip_pct
       FROM trips GROUP BY payment_type""", ["trips"], ["avg_tip_pct"])

register(
    "agg_bar_count",
    lambda s, d: agg.bar_count(analysis(s, d), "pickup_weekday_name", WEEKDAY_ABBR_MON_FIRST),
    """SELECT pickup_weekday_name, count(*) AS n,
              CAST(list_position(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'],
                                 pickup_weekday_name) AS INTEGER) AS level
       FROM feat GROUP BY pickup_weekday_name""", ["feat"])

register(
    "agg_bar_count_fill",
    lambda s, d: agg.bar_count_fill(analysis(s, d), "pickup_weekday_name", "tourist_season"),
    """SELECT pickup_weekday_name, tourist_season, count(*) AS n
       FROM feat GROUP BY pickup_weekday_name, tourist_season""", ["feat"])


def _borough_compare(s, d):
    t = flt.trip_quality(trips(s, d), "final")
    return agg.borough_compare(joins.left_zone_both(t, zones(s, d)), "PUBorough")


register(
    "agg_borough_compare", _borough_compare,
    """SELECT z.Borough AS PUBorough, count(*) AS n,
              quantile_cont(tip_amount, 0.25) AS tip_q1,
              quantile_cont(tip_amount, 0.5) AS tip_median,
              quantile_cont(tip_amount, 0.75) AS tip_q3,
              avg(tip_amount) AS tip_mean,
              avg(CAST(tip_amount = 0 AS DOUBLE)) AS zero_tip_share
       FROM trips t LEFT JOIN zones z ON t.PULocationID = z.LocationID
       WHERE payment_type = 1 AND fare_amount > 0
         AND tpep_pickup_datetime <> tpep_dropoff_datetime
         AND passenger_count = 1 AND airport_fee = 0 AND total_amount > 0
       GROUP BY z.Borough""",
    ["trips", "zones"], ["tip_q1", "tip_median", "tip_q3", "tip_mean", "zero_tip_share"])

register(
    "agg_cond_count",
    lambda s, d: agg.cond_count(all_features(s, d), F.col("trip_minutes") <= 0, "n"),
    "SELECT count(*) FILTER (WHERE trip_minutes <= 0) AS n FROM tfeat", ["tfeat"])

register(
    "agg_null_counts",
    lambda s, d: agg.null_counts(all_features(s, d),
                                 ["passenger_count", "trip_minutes", "trip_speed_mph"]),
    """SELECT count(*) FILTER (WHERE passenger_count IS NULL) AS passenger_count_nulls,
              count(*) FILTER (WHERE trip_minutes IS NULL) AS trip_minutes_nulls,
              count(*) FILTER (WHERE trip_speed_mph IS NULL) AS trip_speed_mph_nulls
       FROM tfeat""", ["tfeat"])

register(
    "agg_quantile",
    lambda s, d: agg.quantile(analysis(s, d), "tip_amount", 0.99, name="tip_p99"),
    "SELECT quantile_cont(tip_amount, 0.99) AS tip_p99 FROM feat", ["feat"], ["tip_p99"])

register(
    "agg_minmax",
    lambda s, d: agg.minmax(analysis(s, d), "tip_amount"),
    "SELECT min(tip_amount) AS min_value, max(tip_amount) AS max_value FROM feat",
    ["feat"], ["min_value", "max_value"])

register(
    "agg_choices",
    lambda s, d: agg.choices(analysis(s, d), "pickup_weekday_name", WEEKDAY_ABBR_MON_FIRST),
    """SELECT DISTINCT pickup_weekday_name,
              CAST(list_position(['Mon','Tue','Wed','Thu','Fri','Sat','Sun'],
                                 pickup_weekday_name) AS INTEGER) AS level
       FROM feat""", ["feat"])

register(
    "prof_unique",
    lambda s, d: agg.unique(trips(s, d), "file_month"),
    "SELECT DISTINCT file_month FROM trips", ["trips"])

register(
    "qual_duration",
    lambda s, d: agg.duration_quality(all_features(s, d)),
    """SELECT count(*) FILTER (WHERE trip_minutes <= 0) AS minutes_le_0,
              count(*) FILTER (WHERE trip_minutes IS NULL) AS minutes_null,
              count(*) FILTER (WHERE tpep_pickup_datetime IS NULL) AS pickup_null,
              count(*) FILTER (WHERE tpep_dropoff_datetime IS NULL) AS dropoff_null,
              count(*) FILTER (WHERE date_trunc('day', tpep_pickup_datetime)
                                     = tpep_pickup_datetime) AS pickup_midnight,
              count(*) FILTER (WHERE date_trunc('day', tpep_dropoff_datetime)
                                     = tpep_dropoff_datetime) AS dropoff_midnight,
              count(*) FILTER (WHERE trip_minutes = 0) AS minutes_eq_0
       FROM tfeat""", ["tfeat"])

register(
    "qual_total_recon",
    lambda s, d: agg.total_reconciliation(
        trips(s, d), ["fare_amount", "extra", "tip_amount", "airport_fee"]),
    """SELECT count(*) AS n,
              count(*) FILTER (WHERE abs(total_amount - (0.0 + fare_amount + extra + tip_amount
                                                         + airport_fee)) > 0.005) AS n_mismatch,
              max(abs(total_amount - (0.0 + fare_amount + extra + tip_amount + airport_fee)))
                AS max_abs_diff
       FROM trips""", ["trips"], ["max_abs_diff"])

# ---------------------------------------------------------------- profiles
PROFILE_NUMERIC = FRAME_KEY + FRAME_NUMERIC


def _index(s, d):
    """The value index of the feature table, made once for all its profiles."""
    return files.materialized(s, f"value-index:{d}", lambda: prof.value_counts(analysis(s, d)))


def _epoch(c):
    return f"(epoch_us(CAST({c} AS TIMESTAMP)) / 1e6)"


def _names(sel):
    return [x.rsplit(" AS ", 1)[1] for x in sel]


def _skim_sql() -> str:
    sel = []
    for c in PROFILE_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        sel += [f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS {c}__n_missing",
                f"count({c}) / count(*) AS {c}__complete_rate",
                f"avg({x}) AS {c}__mean", f"stddev_samp({x}) AS {c}__sd",
                f"min({x}) AS {c}__p0", f"quantile_cont({x}, 0.25) AS {c}__p25",
                f"quantile_cont({x}, 0.5) AS {c}__p50", f"quantile_cont({x}, 0.75) AS {c}__p75",
                f"max({x}) AS {c}__p100"]
    for c in FRAME_STRING:
        sel += [f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS {c}__n_missing",
                f"count({c}) / count(*) AS {c}__complete_rate",
                f"CAST(min(length({c})) AS DOUBLE) AS {c}__min",
                f"CAST(max(length({c})) AS DOUBLE) AS {c}__max",
                f"CAST(count(*) FILTER (WHERE length({c}) = 0) AS DOUBLE) AS {c}__empty",
                f"CAST(count(DISTINCT {c}) AS DOUBLE) AS {c}__n_unique",
                f"CAST(count(*) FILTER (WHERE regexp_matches({c}, '^\\s+$')) AS DOUBLE)"
                f" AS {c}__whitespace"]
    for c in FRAME_TIME + FRAME_DATE:
        e = _epoch(c)
        sel += [f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS {c}__n_missing",
                f"count({c}) / count(*) AS {c}__complete_rate",
                f"min({e}) AS {c}__min", f"max({e}) AS {c}__max",
                f"quantile_cont({e}, 0.5) AS {c}__median",
                f"CAST(count(DISTINCT {c}) AS DOUBLE) AS {c}__n_unique"]
    types = ([f"WHEN '{c}' THEN 'numeric'" for c in PROFILE_NUMERIC]
             + [f"WHEN '{c}' THEN 'character'" for c in FRAME_STRING]
             + [f"WHEN '{c}' THEN 'POSIXct'" for c in FRAME_TIME]
             + [f"WHEN '{c}' THEN 'Date'" for c in FRAME_DATE])
    return f"""
SELECT regexp_extract(key, '^(.*)__(.*)$', 1) AS skim_variable,
       CASE regexp_extract(key, '^(.*)__(.*)$', 1) {' '.join(types)} END AS skim_type,
       regexp_extract(key, '^(.*)__(.*)$', 2) AS stat, CAST(value AS DOUBLE) AS value
FROM (SELECT {', '.join(sel)} FROM feat) w
     UNPIVOT INCLUDE NULLS (value FOR key IN ({', '.join(_names(sel))}))"""


register("prof_skim", lambda s, d: prof.skim(analysis(s, d), _index(s, d)), _skim_sql(), ["feat"], ["value"])


def _skim_hist_sql() -> str:
    parts = []
    for c in PROFILE_NUMERIC:
        x = f"CAST({c} AS DOUBLE)"
        parts.append(f"""
SELECT '{c}' AS variable, CAST(b.bin AS INTEGER) AS bin, count(q.x) AS n
FROM (SELECT unnest(range(8)) AS bin) b LEFT JOIN (
  SELECT {x} AS x, CASE WHEN r.hi = r.lo THEN 0 ELSE least(floor(({x} - r.lo) / ((r.hi - r.lo) / 8)), 7) END AS bin
  FROM feat, (SELECT min({x}) AS lo, max({x}) AS hi FROM feat) r WHERE {c} IS NOT NULL) q ON b.bin = q.bin
GROUP BY b.bin HAVING (SELECT count({c}) FROM feat) > 0""")
    return "\nUNION ALL".join(parts)


register("prof_skim_hist", lambda s, d: prof.skim_hist(analysis(s, d), index=_index(s, d)), _skim_hist_sql(), ["feat"])


def _summary_sql() -> str:
    sel = []
    for c in PROFILE_NUMERIC + FRAME_TIME + FRAME_DATE:
        x = f"CAST({c} AS DOUBLE)" if c in PROFILE_NUMERIC else _epoch(c)
        sel += [f"min({x}) AS {c}__min", f"quantile_cont({x}, 0.25) AS {c}__q1",
                f"quantile_cont({x}, 0.5) AS {c}__median", f"avg({x}) AS {c}__mean",
                f"quantile_cont({x}, 0.75) AS {c}__q3", f"max({x}) AS {c}__max",
                f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS {c}__nas"]
    for c in FRAME_STRING:
        sel += [f"CAST(count(*) AS DOUBLE) AS {c}__length",
                f"CAST(count(*) FILTER (WHERE {c} IS NULL) AS DOUBLE) AS {c}__nas"]
    return f"""
SELECT regexp_extract(key, '^(.*)__(.*)$', 1) AS variable,
       regexp_extract(key, '^(.*)__(.*)$', 2) AS stat, CAST(value AS DOUBLE) AS value
FROM (SELECT {', '.join(sel)} FROM feat) w
     UNPIVOT INCLUDE NULLS (value FOR key IN ({', '.join(_names(sel))}))"""


def _signif_value(df):
    """Means of epoch seconds have more digits than a double's sum keeps."""
    return df.withColumn("value", reg.signif(F.col("value"), 12))


register("prof_summary", lambda s, d: _signif_value(prof.summary(analysis(s, d), _index(s, d))),
         f"SELECT variable, stat, {signif_sql('value', 12)} AS value FROM ({_summary_sql()}) q", ["feat"], ["value"])

# prof_intro and prof_missing run over every column of every trip, where
# passenger_count and speed carry NULLs


def _intro_sql() -> str:
    anynull = " OR ".join(f"{c} IS NULL" for c in FRAME)
    miss = " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in FRAME)
    allm = " + ".join(f"CAST(count({c}) = 0 AS BIGINT)" for c in FRAME)
    k, discrete = len(FRAME), len(FRAME_STRING)
    return f"""
SELECT CAST(count(*) AS BIGINT) AS rows, CAST({k} AS BIGINT) AS columns,
       CAST({discrete} AS BIGINT) AS discrete_columns, CAST({k - discrete} AS BIGINT) AS continuous_columns,
       CAST({allm} AS BIGINT) AS all_missing_columns,
       CAST({miss} AS BIGINT) AS total_missing_values,
       CAST(count(*) FILTER (WHERE NOT ({anynull})) AS BIGINT) AS complete_rows,
       CAST(count(*) * {k} AS BIGINT) AS total_observations
FROM tfeat"""


register("prof_intro", lambda s, d: prof.intro(all_features(s, d)), _intro_sql(), ["tfeat"])


def _missing_sql() -> str:
    sel = ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in FRAME)
    return f"""
SELECT variable, CAST(n_missing AS BIGINT) AS n_missing, n_missing / n AS pct_missing
FROM (UNPIVOT (SELECT count(*) AS n, {sel} FROM tfeat)
      ON {', '.join(FRAME)} INTO NAME variable VALUE n_missing)"""


register("prof_missing", lambda s, d: prof.missing(all_features(s, d)), _missing_sql(), ["tfeat"], ["pct_missing"])

STRUCT_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
# column -> Spark type name of the trip table
TRIP_TYPES = (("l_orderkey", "bigint"), ("l_linenumber", "int"), ("l_partkey", "bigint"),
              ("l_suppkey", "bigint"), ("tpep_pickup_datetime", "timestamp_ntz"),
              ("tpep_dropoff_datetime", "timestamp_ntz"), ("fare_amount", "double"),
              ("tip_amount", "double"), ("trip_distance", "double"), ("extra", "double"),
              ("payment_type", "int"), ("passenger_count", "int"), ("airport_fee", "double"),
              ("total_amount", "double"), ("PULocationID", "int"), ("DOLocationID", "int"),
              ("file_month", "string"))


def _structure_sql():
    key = ", ".join(STRUCT_KEY)
    parts = [f"SELECT '{c}' AS variable, '{t}' AS type, string_agg(CAST({c} AS VARCHAR), ', '"
             f" ORDER BY {key}) AS first_values FROM h" for c, t in TRIP_TYPES]
    return "\nUNION ALL ".join(parts)


register("prof_structure",
         lambda s, d: prof.structure(trips(s, d), 5, STRUCT_KEY), _structure_sql(), ["trips"], (),
         {"h": f"SELECT * FROM trips ORDER BY {', '.join(STRUCT_KEY)} LIMIT 5"})
