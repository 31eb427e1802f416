"""Registered chart-table, sampling, ordering and paging queries
(SURVEY §2.5, §2.6)."""

from pyspark.sql import functions as F

from tipscope.catalog.base import analysis, register, selected, trips
from tipscope.catalog.basics import (FEAT_DOUBLES, GCENT_CTE, KEY, QV_SQL, RECODE_SQL,
                                     TRIP_DOUBLES, _recoded)
from tipscope.operators import binning as bn
from tipscope.operators import sampling as smp
from tipscope.operators import smooth
from tipscope.operators import trends
from tipscope.operators.aggregates import count_by
from tipscope.plans import dashboard as dash
from tipscope.sources.fixtures import TRIP_KEY

# ---------------------------------------------------------------- §2.5 histograms, boxes, density


def _hist_sql(col, bins, src="feat"):
    return f"""
SELECT g.bin, lo + g.bin * ((hi - lo) / {bins}) AS xmin, lo + (g.bin + 1) * ((hi - lo) / {bins}) AS xmax,
       coalesce(n, 0) AS n
FROM (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {src}) e,
     (SELECT CAST(unnest(range({bins})) AS INTEGER) AS bin) g LEFT JOIN
     (SELECT CAST(CASE WHEN r.hi = r.lo THEN 0
                       ELSE least(floor((x - r.lo) / ((r.hi - r.lo) / {bins})), {bins - 1}) END
                  AS INTEGER) AS bin, count(*) AS n
      FROM (SELECT CAST({col} AS DOUBLE) AS x FROM {src} WHERE {col} IS NOT NULL) v,
           (SELECT min(CAST({col} AS DOUBLE)) AS lo, max(CAST({col} AS DOUBLE)) AS hi FROM {src}) r
      GROUP BY 1) c ON c.bin = g.bin
WHERE lo IS NOT NULL AND (g.bin = 0 OR hi > lo)"""


register("hist_equal", lambda s, d: bn.hist_equal(analysis(s, d), "tip_pct", 100, (0, 150)),
         "SELECT * FROM (" + _hist_sql("tip_pct", 100) + ") h WHERE xmax >= 0 AND xmin <= 150",
         ["feat"], ["xmin", "xmax"])

register(
    "hist_median_line",
    lambda s, d: bn.hist_median_line(analysis(s, d), "tip_amount", 100, (0, 20)),
    "SELECT h.*, m.median, format('{:.2f}', round(m.median, 2)) AS median_label FROM ("
    + _hist_sql("tip_amount", 100) + ") h, (SELECT quantile_cont(tip_amount, 0.5) AS median"
    " FROM feat) m WHERE xmax >= 0 AND xmin <= 20", ["feat"], ["xmin", "xmax", "median"])

PRETTY_SQL = """
WITH st AS (SELECT min(x) AS lo, max(x) AS hi, count(x) AS n
            FROM (SELECT CAST(trip_speed_mph AS DOUBLE) AS x FROM feat) v),
c AS (SELECT *, greatest((hi - lo) / ceil(log2(n) + 1), 1e-12) AS cell FROM st),
b AS (SELECT *, pow(10.0, floor(log10(cell))) AS base FROM c),
u1 AS (SELECT *, CASE WHEN 2 * base - cell < 1.5 * (cell - base) THEN 2 * base ELSE base END AS u1
       FROM b),
u2 AS (SELECT *, CASE WHEN 5 * base - cell < 2.75 * (cell - u1) THEN 5 * base ELSE u1 END AS u2
       FROM u1),
u3 AS (SELECT *, CASE WHEN 10 * base - cell < 1.5 * (cell - u2) THEN 10 * base ELSE u2 END AS u
       FROM u2),
s AS (SELECT u, floor(lo / u) * u AS b0, hi FROM u3),
g AS (SELECT b0, u, CAST(unnest(range(1, CAST(greatest(ceil((hi - b0) / u), 1) AS BIGINT) + 1)) AS INTEGER) AS bin FROM s)
SELECT g.bin, b0 + (g.bin - 1) * u AS break_lo, b0 + g.bin * u AS break_hi, coalesce(n, 0) AS n
FROM g LEFT JOIN
     (SELECT CAST(greatest(ceil((x - b0) / u), 1) AS INTEGER) AS bin, count(*) AS n
      FROM (SELECT CAST(trip_speed_mph AS DOUBLE) AS x FROM feat
            WHERE trip_speed_mph IS NOT NULL) v, s
      GROUP BY 1) q ON q.bin = g.bin"""

register("hist_pretty", lambda s, d: bn.hist_pretty(analysis(s, d), "trip_speed_mph"),
         PRETTY_SQL, ["feat"], ["break_lo", "break_hi"])

BOX_SQL = """
WITH q AS (SELECT pickup_weekday_name, quantile_cont(tip_pct, 0.25) AS q1,
                  quantile_cont(tip_pct, 0.5) AS median, quantile_cont(tip_pct, 0.75) AS q3
           FROM feat WHERE tip_pct IS NOT NULL GROUP BY 1),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.pickup_weekday_name, q1, median, q3, lower_fence, upper_fence, count(*) AS n,
       min(tip_pct) FILTER (WHERE tip_pct BETWEEN lower_fence AND upper_fence) AS whisker_low,
       max(tip_pct) FILTER (WHERE tip_pct BETWEEN lower_fence AND upper_fence) AS whisker_high,
       count(*) FILTER (WHERE NOT (tip_pct BETWEEN lower_fence AND upper_fence)) AS n_outliers
FROM feat JOIN f ON feat.pickup_weekday_name = f.pickup_weekday_name
WHERE tip_pct IS NOT NULL
GROUP BY f.pickup_weekday_name, q1, median, q3, lower_fence, upper_fence"""

register("box_stats", lambda s, d: bn.box_stats(analysis(s, d), "tip_pct", "pickup_weekday_name"),
         BOX_SQL, ["feat"],
         ["q1", "median", "q3", "lower_fence", "upper_fence", "whisker_low", "whisker_high"])

register(
    "box_outliers",
    lambda s, d: bn.box_outliers(analysis(s, d), "tip_amount", "pickup_weekday_name"),
    """WITH q AS (SELECT pickup_weekday_name AS g, quantile_cont(tip_amount, 0.25) AS q1,
                         quantile_cont(tip_amount, 0.75) AS q3
                  FROM feat WHERE tip_amount IS NOT NULL GROUP BY 1)
       SELECT feat.* FROM feat JOIN q ON feat.pickup_weekday_name = q.g
       WHERE tip_amount < q1 - 1.5 * (q3 - q1) OR tip_amount > q3 + 1.5 * (q3 - q1)""",
    ["feat"], FEAT_DOUBLES)

KDE_SQL = """
WITH base AS (SELECT tourist_season, CAST(tip_amount AS DOUBLE) AS x FROM feat
              WHERE tip_amount IS NOT NULL),
vc AS (SELECT tourist_season, x, count(*) AS c FROM base GROUP BY 1, 2),
st AS (SELECT tourist_season, count(*) AS n, stddev_samp(x) AS sd,
              quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3,
              min(x) AS mn, max(x) AS mx FROM base GROUP BY 1),
bw AS (SELECT *, 0.9 * least(sd, (q3 - q1) / 1.34) * pow(CAST(n AS DOUBLE), -0.2) AS bw FROM st),
g AS (SELECT *, mn - 3.0 * bw AS glo, mx + 3.0 * bw AS ghi FROM bw),
k AS (SELECT vc.tourist_season, i, g.glo, g.ghi, g.n, g.bw,
             sum(vc.c * exp(-0.5 * ((g.glo + i * (g.ghi - g.glo) / 511 - vc.x) / g.bw)
                                  * ((g.glo + i * (g.ghi - g.glo) / 511 - vc.x) / g.bw))) AS s
      FROM vc JOIN g ON vc.tourist_season = g.tourist_season,
           (SELECT CAST(unnest(range(0, 512)) AS INTEGER) AS i) r
      GROUP BY 1, 2, 3, 4, 5, 6)
SELECT tourist_season, i, glo + i * (ghi - glo) / 511 AS x,
       s / (n * bw * sqrt(2 * pi())) AS density, bw
FROM k"""

register("dens_kde", lambda s, d: bn.kde(analysis(s, d), "tip_amount", "tourist_season"),
         KDE_SQL, ["feat"], ["x", "density", "bw"])

register(
    "scat_points",
    lambda s, d: bn.scatter(analysis(s, d), "fare_amount", "tip_amount",
                            view={"fare_amount": (0, 65)}, key=TRIP_KEY),
    f"""SELECT {KEY}, fare_amount AS x, tip_amount AS y FROM feat
        WHERE fare_amount BETWEEN 0 AND 65""", ["feat"], ["x", "y"])

register(
    "scat_zero_flag",
    lambda s, d: bn.scatter(analysis(s, d), "fare_amount", "tip_amount", bn.zero_flag(),
                            key=TRIP_KEY),
    f"SELECT {KEY}, fare_amount AS x, tip_amount AS y, tip_amount = 0 AS color FROM feat",
    ["feat"], ["x", "y"])

register(
    "scat_dashboard",
    lambda s, d: dash.scatter(_recoded(s, d), "fare_amount", "tip_amount", "tourist_season"),
    """SELECT fare_amount AS x, tip_amount AS y, tourist_season AS color,
              concat_ws('<br>', 'fare_amount: ' || CAST(fare_amount AS VARCHAR),
                        'tip_amount: ' || CAST(tip_amount AS VARCHAR),
                        'tourist_season: ' || tourist_season) AS tooltip
       FROM recoded WHERE fare_amount IS NOT NULL AND tip_amount IS NOT NULL""",
    ["feat"], ["x", "y"], {"recoded": RECODE_SQL})

register(
    "trend_lm", lambda s, d: trends.lm(analysis(s, d), "fare_amount", "tip_amount"),
    """SELECT regr_slope(tip_amount, fare_amount) AS slope,
              regr_intercept(tip_amount, fare_amount) AS intercept,
              regr_r2(tip_amount, fare_amount) AS r2,
              CAST(regr_count(tip_amount, fare_amount) AS BIGINT) AS n FROM feat""",
    ["feat"], ["slope", "intercept", "r2"])

register(
    "trend_lm_grid", lambda s, d: trends.lm_grid(analysis(s, d), "fare_amount", "tip_amount"),
    """SELECT i, lo + i * (hi - lo) / 199 AS x, intercept + slope * (lo + i * (hi - lo) / 199) AS y_hat
       FROM (SELECT regr_slope(tip_amount, fare_amount) AS slope,
                    regr_intercept(tip_amount, fare_amount) AS intercept,
                    min(fare_amount) AS lo, max(fare_amount) AS hi
             FROM feat WHERE fare_amount IS NOT NULL AND tip_amount IS NOT NULL) f,
            (SELECT CAST(unnest(range(0, 200)) AS INTEGER) AS i) g""",
    ["feat"], ["x", "y_hat"])


def _loess(s, d):
    pts = (analysis(s, d).groupBy("tourist_season", "pickup_hour")
           .agg(F.percentile("tip_amount", F.lit(0.5)).alias("median_tip")))
    return smooth.loess(pts, "pickup_hour", "median_tip", "tourist_season")


LOESS_SQL = """
WITH pts AS (SELECT tourist_season, CAST(pickup_hour AS DOUBLE) AS x,
                    quantile_cont(tip_amount, 0.5) AS y FROM feat GROUP BY 1, 2),
j AS (SELECT a.tourist_season, a.x AS x0, b.x, b.y, abs(b.x - a.x) AS d,
             count(*) OVER (PARTITION BY a.tourist_season, a.x) AS n,
             row_number() OVER (PARTITION BY a.tourist_season, a.x ORDER BY abs(b.x - a.x), b.x)
               AS rk
      FROM pts a JOIN pts b ON a.tourist_season = b.tourist_season),
h AS (SELECT *, max(CASE WHEN rk = greatest(floor(n * 0.75), 1) THEN d END)
                  OVER (PARTITION BY tourist_season, x0) AS h FROM j),
w AS (SELECT tourist_season, x0, y, x - x0 AS t,
             CASE WHEN h > 0 AND d / h < 1 THEN pow(1 - pow(d / h, 3), 3)
                  WHEN h = 0 AND d = 0 THEN 1.0 ELSE 0.0 END AS w FROM h),
s AS (SELECT tourist_season, x0, sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2,
             sum(w * t * t * t) AS s3, sum(w * t * t * t * t) AS s4, sum(w * y) AS r0,
             sum(w * t * y) AS r1, sum(w * t * t * y) AS r2 FROM w GROUP BY 1, 2)
SELECT tourist_season, x0 AS x,
       (r0 * (s2 * s4 - s3 * s3) - s1 * (r1 * s4 - s3 * r2) + s2 * (r1 * s3 - s2 * r2))
       / nullif(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2), 0)
         AS fitted
FROM s"""

register("trend_loess", _loess, LOESS_SQL, ["feat"], ["x", "fitted"])

LOESS_POINTS_SQL = """
WITH p AS (SELECT tourist_season, CAST(fare_amount AS DOUBLE) AS x, CAST(tip_amount AS DOUBLE) AS y
           FROM feat WHERE fare_amount IS NOT NULL AND tip_amount IS NOT NULL),
g AS (SELECT DISTINCT tourist_season, lo + i * (hi - lo) / 19 AS x0
      FROM (SELECT tourist_season, min(x) AS lo, max(x) AS hi FROM p GROUP BY 1) e,
           (SELECT unnest(range(0, 20)) AS i) n),
j AS (SELECT g.tourist_season, x0, y, x - x0 AS t, abs(x - x0) AS d,
             count(*) OVER (PARTITION BY g.tourist_season, x0) AS n,
             row_number() OVER (PARTITION BY g.tourist_season, x0 ORDER BY abs(x - x0)) AS rk
      FROM g JOIN p ON g.tourist_season = p.tourist_season),
h AS (SELECT *, max(CASE WHEN rk = greatest(floor(n * 0.75), 1) THEN d END)
                  OVER (PARTITION BY tourist_season, x0) AS h FROM j),
w AS (SELECT tourist_season, x0, y, t / h AS t, pow(1 - pow(d / h, 3), 3) AS w FROM h WHERE d < h),
s AS (SELECT tourist_season, x0, sum(w) AS s0, sum(w * t) AS s1, sum(w * t * t) AS s2,
             sum(w * t * t * t) AS s3, sum(w * t * t * t * t) AS s4, sum(w * y) AS r0,
             sum(w * t * y) AS r1, sum(w * t * t * y) AS r2 FROM w GROUP BY 1, 2)
SELECT g.tourist_season, g.x0 AS x,
       (r0 * (s2 * s4 - s3 * s3) - s1 * (r1 * s4 - s3 * r2) + s2 * (r1 * s3 - s2 * r2))
       / nullif(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s3 * s2) + s2 * (s1 * s3 - s2 * s2), 0)
         AS fitted
FROM g LEFT JOIN s ON s.tourist_season = g.tourist_season AND s.x0 = g.x0"""

register("trend_loess_points",
         lambda s, d: smooth.loess(analysis(s, d), "fare_amount", "tip_amount", "tourist_season", steps=20),
         LOESS_POINTS_SQL, ["feat"], ["x", "fitted"])

# no SQL: the weight of the penalty is searched for; tests compare with the row-wise solution
register("trend_spline", lambda s, d: smooth.spline(analysis(s, d), "fare_amount", "tip_pct"))

# ---------------------------------------------------------------- §2.6 sampling, ordering, paging
STRAT_SQL = f"""SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY file_month
        ORDER BY md5(concat_ws('|', '123', {KEY})), {KEY}) AS rn FROM sel) q
  WHERE rn <= 40"""


def _strat(s, d):
    return smp.stratified(selected(s, d), "file_month", 40, TRIP_KEY, 123)


register("smp_stratified", _strat, STRAT_SQL, ["sel"], TRIP_DOUBLES)
register("smp_check", lambda s, d: count_by(_strat(s, d), "file_month"),
         "SELECT file_month, count(*) AS n FROM (" + STRAT_SQL + ") q GROUP BY 1", ["sel"])
register("smp_fixed_n", lambda s, d: smp.fixed_n(trips(s, d), 1000, TRIP_KEY, 123),
         f"SELECT * FROM trips ORDER BY md5(concat_ws('|', '123', {KEY})), {KEY} LIMIT 1000",
         ["trips"], TRIP_DOUBLES)

register(
    "win_pct_share",
    lambda s, d: dash.bar(analysis(s, d), "pickup_weekday_name", "tourist_season", percent=True),
    """SELECT pickup_weekday_name, tourist_season, count(*) AS n,
              count(*) / sum(count(*)) OVER (PARTITION BY pickup_weekday_name) AS share
       FROM feat GROUP BY 1, 2""", ["feat"], ["share"])


def _topk_scores(s, d):
    from tipscope.catalog.basics import _query_vector_scores
    sc = _query_vector_scores(s, d)
    # rank on the score rounded to 9 places (as the oracle does) so float noise cannot reorder
    return smp.topk(sc.withColumn("score", F.round(F.col("score") * 1e9) / 1e9), "score", 3,
                    ["vec_id"])


register(
    "srt_topk_desc", _topk_scores,
    "SELECT vec_id, label, round(score, 9) AS score FROM (" + QV_SQL
    + ") q ORDER BY round(score, 9) DESC, vec_id LIMIT 3", (), ["score"], GCENT_CTE)

register("lim_head", lambda s, d: smp.head(trips(s, d), 10, TRIP_KEY),
         f"SELECT * FROM trips ORDER BY {KEY} LIMIT 10", ["trips"], TRIP_DOUBLES)

register("lim_page", lambda s, d: dash.table_page(analysis(s, d), TRIP_KEY, None, 3, 25),
         f"SELECT * FROM feat ORDER BY {KEY} LIMIT 25 OFFSET 50", ["feat"], FEAT_DOUBLES)


def _row_lookup(s, d):
    keys = smp.topk(analysis(s, d), "tip_amount", 10, TRIP_KEY).select(*TRIP_KEY)
    return smp.row_lookup(trips(s, d), keys, TRIP_KEY)


register(
    "lim_row_lookup", _row_lookup,
    f"""SELECT * FROM trips WHERE ({KEY}) IN (
          SELECT ({KEY}) FROM feat ORDER BY tip_amount DESC, {KEY} LIMIT 10)""",
    ["trips", "feat"], TRIP_DOUBLES)
