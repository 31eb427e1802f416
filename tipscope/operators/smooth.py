"""Smoothers behind the scatter charts: local quadratic fits and penalised splines.

``loess`` fits a weighted quadratic at each target x0 to the ``q`` points nearest
to it. Points are first counted by (series, x), and nothing below joins points
with points:

1. Points are put in order and numbered (``ranges.py``). In a series' rows x(0),
   x(1), ... the q nearest to x0 are consecutive; they start at the first i with
   x(i) + x(i + q) >= 2 x0. That sum changes only where x(i) or x(i + q) does, so
   it is a table of at most two pieces a point. Pieces and targets sorted
   together, with a running count of pieces, give each target its piece, hence
   its window and the distance h of its q-th point.
2. The cuts x0 - h, x0 and x0 + h of all targets part the line into intervals
   that each fit takes whole or not at all. Points and cuts sorted together give
   each point its interval; an interval keeps power sums of its points (one
   aggregation, added up map-side).
3. The tricube weight is a polynomial in the distance from the window's edge, so
   a fit's weighted sums follow from the power sums of its intervals.

Points are sorted a fixed number of times, whatever the number of targets, and a
point of which every trip has a copy is one row. Step 3 joins a series' targets
with its intervals, three for each target: long series want ``steps`` targets
rather than one at each point. Where every series is short (counted first), its
targets are joined with its few counted points instead.

``spline`` needs one pass for the range and one for the cross-products of the
basis; the rest is a system as large as the basis.
"""

from __future__ import annotations

import math
from typing import Sequence

import numpy as np
import pandas as pd
from numpy.polynomial import polynomial as poly
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tipscope.functions.shipping import ship
from tipscope.functions.sizing import broadcast_if_small
from tipscope.operators import ranges as rg
from tipscope.operators.moments import listwise
from tipscope.sources.files import stored

ship(__name__)

#: Distinct points of a series up to which its targets are joined with them.
SHORT = 500
#: Packs two running counts in one number.
UPPER = 1 << 31
#: The tricube weight by v, the distance from the window's edge as a share of h,
#: times the j-th power of 1 - v, the distance from the target.
WEIGHT = poly.polymul([0, 0, 0, 1], poly.polypow([3, -3, 1], 3))
WEIGHTS = [poly.polymul(WEIGHT, poly.polypow([1, -1], j)) for j in range(5)]
POWERS, Y_POWERS = len(WEIGHTS[4]), len(WEIGHTS[2])
SUMS = [f"s{j}" for j in range(5)] + [f"r{j}" for j in range(3)]
#: A determinant below this share of its diagonal says that the points of a
#: window don't determine a quadratic.
SINGULAR = 1e-12


def loess(points: DataFrame, x: str, y: str, group: str | Sequence[str] | None = None, span: float = 0.75,
          steps: int | None = None, short: int = SHORT, range_rows: int = rg.RANGE_ROWS) -> DataFrame:
    """Local quadratic fit of ``y`` at each distinct ``x`` of a series or, with
    ``steps``, at so many equal steps from its least to its greatest (trend_loess):
    the group columns, ``x`` and ``fitted``.

    The ``floor(span * n)`` nearest points, one at least, get tricube weights
    (1 - (d/h)^3)^3, h being the greatest of their distances. Points with a
    missing or infinite value are left out; NULL is a group like others;
    ``fitted`` is NULL where the points with a weight don't determine a quadratic:
    fewer than three different x, or a cluster so far from the target, for its
    width, that the value there would be rounding errors (``SINGULAR``).
    """
    if not 0 < span <= 1 or (steps is not None and steps < 2):
        raise ValueError("span is over 0 and at most 1, steps at least 2")
    keys = [] if group is None else [group] if isinstance(group, str) else list(group)
    series_key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    p = points.select(series_key.alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    p = p.where((F.abs("_x") < math.inf) & (F.abs("_y") < math.inf))
    counted = stored(p.groupBy("_k", "_x").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_sy")), "points")
    sizes = counted.groupBy("_k").agg(
        F.count(F.lit(1)).alias("_points"), F.sum("_n").alias("_total"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    sizes = sizes.withColumn("_q", F.greatest(F.floor(F.col("_total") * span), F.lit(1).cast("long")))
    longest = sizes.agg(F.max("_points")).first()[0] or 0
    if longest <= short:
        fits = _joined_fits(counted, sizes, steps)
    else:
        fits = _ranged_fits(counted, sizes, steps, range_rows)
    return fits.select(*[F.col("_k")[k].alias(k) for k in keys], F.col("_x0").alias("x"), "fitted")


def _targets(points: DataFrame, sizes: DataFrame, steps: int | None, key: str) -> DataFrame:
    if steps is None:
        return points.select(key, F.col("_x").alias("_x0"))
    i = F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))
    return (sizes.select(key, "_lo", "_hi", i.alias("_i"))
            .select(key, (F.col("_lo") + F.col("_i") * (F.col("_hi") - F.col("_lo")) / (steps - 1)).alias("_x0")).distinct())


def _solved():
    """The fitted value from the weighted sums (Cramer's rule)."""
    s0, s1, s2, s3, s4, r0, r1, r2 = (F.col(c) for c in SUMS)
    a, b, c = s2 * s4 - s3 * s3, s1 * s4 - s3 * s2, s1 * s3 - s2 * s2
    det = s0 * a - s1 * b + s2 * c
    top = r0 * a - s1 * (r1 * s4 - s3 * r2) + s2 * (r1 * s3 - s2 * r2)
    return F.when(det > SINGULAR * s0 * s2 * s4, top / det)


# ------------------------------------------------------------------ short series
def _joined_fits(points: DataFrame, sizes: DataFrame, steps: int | None) -> DataFrame:
    """Each target with the counted points of its series, at most ``short``."""
    targets = _targets(points, sizes, steps, "_k")
    j = targets.join(points, "_k").join(sizes.select("_k", "_q"), "_k").withColumn("_d", F.abs(F.col("_x") - F.col("_x0")))
    target = Window.partitionBy("_k", "_x0")
    j = j.withColumn("_upto", F.sum("_n").over(target.orderBy("_d", "_x")))
    j = j.withColumn("_h", F.min(F.when(F.col("_upto") >= F.col("_q"), F.col("_d"))).over(target))
    t = F.col("_x") - F.col("_x0")
    t = F.when(F.col("_d") < F.col("_h"), t / F.col("_h"))  # NULL: no weight
    w = F.pow(1 - F.pow(F.abs(t), 3), 3)
    sums = [F.sum(F.col("_n") * w * F.pow(t, j)).alias(f"s{j}") for j in range(5)]
    sums += [F.sum(F.col("_sy") * w * F.pow(t, j)).alias(f"r{j}") for j in range(3)]
    return j.groupBy("_k", "_x0").agg(*sums).select("_k", "_x0", _solved().alias("fitted"))


# ------------------------------------------------------------------ series of any length
def _ranged_fits(counted: DataFrame, sizes: DataFrame, steps: int | None, range_rows: int) -> DataFrame:
    small = lambda df: broadcast_if_small(df, rg.DIRECTORY_ROWS)
    placed = stored(rg.directory(counted, ["_k", "_x"], "_n", range_rows).running("_n", place=True), "placed")
    # a series is named by the place of its first point
    named = placed.groupBy("_k").agg(F.min("_pos").alias("_s"), F.min("_offset").alias("_first_row"))
    series = stored(sizes.join(named, "_k"), "series")
    points = stored(placed.join(small(series.select("_k", "_s", "_first_row", "_total", "_q")), "_k")
                    .select("_s", "_pos", "_x", "_n", "_sy", "_total", "_q", (F.col("_offset") - F.col("_first_row")).alias("_row")),
                    "points")
    targets = _targets(points, series, steps, "_s")
    windows = stored(_windows(points, series, targets, range_rows), "windows")
    sums = _interval_sums(points, windows, range_rows)
    fields = "_s long, _x0 double, " + ", ".join(f"{c} double" for c in SUMS)
    held = (windows.join(sums, "_s").where((F.col("_low") >= F.col("_x0") - F.col("_h")) & (F.col("_low") < F.col("_x0") + F.col("_h")))
            .mapInPandas(_weighted, fields).groupBy("_s", "_x0").agg(*[F.sum(c).alias(c) for c in SUMS]))
    return (windows.join(held, ["_s", "_x0"], "left").join(small(series.select("_s", "_k")), "_s")
            .select("_k", "_x0", _solved().alias("fitted")))


def _windows(points: DataFrame, series: DataFrame, targets: DataFrame, range_rows: int) -> DataFrame:
    """(_s, _x0, _h): of each target the distance of its q-th nearest point."""
    starts = points.select("_s", F.col("_row").alias("_i"), F.lit(1).alias("_e"))
    ends = points.select("_s", F.greatest(F.col("_row") - F.col("_q"), F.lit(0)).alias("_i"), F.lit(UPPER))
    last = series.select("_s", (F.col("_total") - F.col("_q")).alias("_i"), F.lit(0))
    events = starts.unionAll(ends).unionAll(last).groupBy("_s", "_i").agg(F.sum("_e").alias("_e"))
    pieces = rg.directory(events, ["_s", "_i"], "_e", range_rows).running("_e", place=True)
    both = F.col("_offset") + F.col("_e")
    pieces = pieces.select("_s", "_i", F.col("_pos").alias("_piece"), (both % UPPER - 1).alias("_start"),
                           (F.shiftright(both, 31) - 1).alias("_after"))
    at = points.select("_pos", "_x", "_row", "_q", "_total")
    pieces = pieces.join(at.select(F.col("_pos").alias("_start"), F.col("_x").alias("_x_start"), "_q", "_total"), "_start")
    pieces = pieces.join(at.select(F.col("_pos").alias("_after"), F.col("_x").alias("_x_after"), F.col("_row").alias("_row_after")), "_after")
    # row i + q is the first of its point: the window ends with the point before
    end = F.col("_after") - (F.col("_row_after") == F.col("_i") + F.col("_q")).cast("long")
    pieces = pieces.withColumn("_end", end).join(at.select(F.col("_pos").alias("_end"), F.col("_x").alias("_x_end")), "_end")
    move = F.when(F.col("_i") < F.col("_total") - F.col("_q"), F.col("_x_start") + F.col("_x_after")).otherwise(math.inf)
    pieces = stored(pieces.select("_s", "_piece", "_x_start", "_x_end", move.alias("_move")), "pieces")
    marks = pieces.select("_s", F.col("_move").alias("_v"), F.lit(1).alias("_mark"), F.lit(None).cast("double").alias("_x0"))
    asked = targets.select("_s", (2 * F.col("_x0")).alias("_v"), F.lit(0), "_x0")
    found = rg.directory(marks.unionAll(asked), ["_s", "_v", "_mark"], "_mark", range_rows).running("_mark").where("_mark = 0")
    h = F.greatest(F.col("_x0") - F.col("_x_start"), F.col("_x_end") - F.col("_x0"))
    return (found.select("_s", "_x0", F.col("_offset").alias("_piece")).join(pieces.drop("_s"), "_piece")
            .select("_s", "_x0", h.alias("_h")))


def _interval_sums(points: DataFrame, windows: DataFrame, range_rows: int) -> DataFrame:
    """Of each interval that starts at a cut: ``_low``, the cut, and sums of the
    powers of the distances from it, plain and times y."""
    x0, h = F.col("_x0"), F.col("_h")
    cuts = windows.where("_h > 0").select("_s", F.explode(F.array(x0 - h, x0, x0 + h)).alias("_v")).distinct()
    none = F.lit(None)
    merged = cuts.select("_s", "_v", F.lit(1).alias("_cut"), none.cast("long").alias("_n"), none.cast("double").alias("_sy")).unionAll(
        points.select("_s", F.col("_x").alias("_v"), F.lit(0), "_n", "_sy")).withColumn("_point", 1 - F.col("_cut"))
    # a point that lies on a cut comes after it
    counted = stored(rg.directory(merged, ["_s", "_v", "_point"], "_cut", range_rows).running("_cut"), "intervals")
    low = counted.where("_cut = 1").select("_s", F.col("_offset").alias("_at_cut"), F.col("_v").alias("_low"))
    held = counted.where("_cut = 0").withColumn("_at_cut", F.col("_offset") - 1)
    held = held.join(broadcast_if_small(low, rg.DIRECTORY_ROWS), ["_s", "_at_cut"])
    d = F.col("_v") - F.col("_low")
    sums = [F.sum(F.col("_n") * F.pow(d, F.lit(i))).alias(f"n{i}") for i in range(POWERS)]
    sums += [F.sum(F.col("_sy") * F.pow(d, F.lit(i))).alias(f"y{i}") for i in range(Y_POWERS)]
    return held.groupBy("_s", "_at_cut", "_low").agg(*sums).drop("_at_cut")


def _weighted(frames):
    """For each target and interval, the interval's share of the target's sums."""
    for f in frames:
        x0, h, low = (f[c].to_numpy() for c in ("_x0", "_h", "_low"))
        side = np.where(low >= x0, 1.0, -1.0)
        # a point's distance from the window's edge: a - side * d, as a share of h
        a = np.where(side > 0, x0 + h - low, low - (x0 - h)) / h
        back = np.vstack([a ** i for i in range(POWERS)])

        def moments(name, top):
            m = [f[f"{name}{i}"].to_numpy(dtype=np.float64) * (-side / h) ** i for i in range(top)]
            return [sum(math.comb(k, i) * back[k - i] * m[i] for i in range(k + 1)) for k in range(top)]

        n, ys = moments("n", POWERS), moments("y", Y_POWERS)
        out = {"_s": f["_s"], "_x0": x0}
        for j, w in enumerate(WEIGHTS):
            out[f"s{j}"] = side ** j * sum(c * n[k] for k, c in enumerate(w))
        for j, w in enumerate(WEIGHTS[:3]):
            out[f"r{j}"] = side ** j * sum(c * ys[k] for k, c in enumerate(w))
        yield pd.DataFrame(out)


# ------------------------------------------------------------------ penalised spline
def _bump(t):
    """The cubic B-spline on equal knots by the distance from its middle, in knots."""
    t = F.abs(t)
    return F.when(t < 1, 2 / 3 - t * t + t * t * t / 2).when(t < 2, (2 - t) * (2 - t) * (2 - t) / 6).otherwise(0.0)


def bumps(u: np.ndarray, segments: int) -> np.ndarray:
    t = np.abs(u[:, None] - np.arange(-1, segments + 2))
    return np.where(t < 1, 2 / 3 - t * t + t ** 3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


def penalised(xx: np.ndarray, xy: np.ndarray, yy: float, n: int) -> tuple[np.ndarray, float, float]:
    """Coefficients with second differences penalised, the penalty's weight and the
    effective degrees of freedom. The weight has the least generalised
    cross-validation score of 121 between 1e-6 and 1e6 of the cross-products' scale."""
    rough = np.diff(np.eye(len(xy)), 2, axis=0)
    rough = rough.T @ rough
    best = None
    for weight in np.trace(xx) / len(xy) * np.logspace(-6, 6, 121):
        both = np.linalg.solve(xx + weight * rough, np.column_stack([xx, xy]))
        b, edf = both[:, -1], float(np.trace(both[:, :-1]))
        rss = max(yy - 2 * b @ xy + b @ xx @ b, 0.0)
        if n - edf > 1e-9:
            score = n * rss / (n - edf) ** 2
            if best is None or score < best[0]:
                best = score, b, float(weight), edf
    if best is None:  # no points to spare: the straight line
        return b, float(weight), edf
    return best[1:]


def spline(df: DataFrame, x: str, y: str, segments: int = 10, steps: int = 80) -> DataFrame:
    """Penalised cubic spline of ``y`` on ``x`` (trend_spline): ``i``, ``x`` and
    ``y_hat`` at ``steps`` equal steps over the range of x, ``edf`` the effective
    degrees of freedom.

    The basis are cubic B-splines on ``segments`` equal parts of the range. One
    pass finds the range, one the cross-products; only these reach the driver.
    Rows with a missing or infinite value are left out. Of no rows, the result is
    empty; where x has one value, one row with the mean of y.
    """
    spark = df.sparkSession
    p = df.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    p = p.where((F.abs("_x") < math.inf) & (F.abs("_y") < math.inf))
    lo, hi, mean = p.agg(F.min("_x"), F.max("_x"), F.avg("_y")).first()
    fields = "i int, x double, y_hat double, edf double"
    if lo is None or lo == hi:
        return spark.createDataFrame([] if lo is None else [(0, lo, mean, 1.0)], fields)
    u = (F.col("_x") - lo) / ((hi - lo) / segments)
    basis = {f"b{j}": _bump(u - float(j)) for j in range(-1, segments + 2)}
    m = listwise(p, {**basis, "_y": F.col("_y")}, [[*basis, "_y"]])[0]
    at = m.mean[:-1]
    # the basis adds up to 1, so the mean of y may be taken off first and added last
    b, _, edf = penalised(m.sxx[:-1, :-1] + m.n * np.outer(at, at), m.sxx[:-1, -1], m.sxx[-1, -1], m.n)
    grid = np.linspace(0, segments, steps)
    fitted = bumps(grid, segments) @ b + m.mean[-1]
    return spark.createDataFrame(
        [(i, float(lo + g * (hi - lo) / segments), float(f), edf) for i, (g, f) in enumerate(zip(grid, fitted))], fields)
