"""Trend lines behind the scatter charts.

Straight-line fits are SQL regression aggregates (``regr_slope`` &c.), so
a fit per group is one grouped aggregate. Smoothers are in ``smooth.py``.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tipscope.operators.regression import fit, term


def _keys(group):
    if group is None:
        return []
    return [group] if isinstance(group, str) else list(group)


def lm(df: DataFrame, x: str, y: str, group: str | Sequence[str] | None = None) -> DataFrame:
    """y ~ x per group: slope, intercept, R², n (trend_lm)."""
    keys = _keys(group)
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    aggs = [F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept"),
            F.regr_r2(Y, X).alias("r2"), F.regr_count(Y, X).alias("n")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def lm_grid(df: DataFrame, x: str, y: str, steps: int = 200) -> DataFrame:
    """Fit y ~ x, then predict at ``steps`` equal steps from min(x) to max(x)
    (trend_lm_grid), over rows with both values. One aggregate; the grid is
    generated from it."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    X, Y = F.col(x).cast("double"), F.col(y).cast("double")
    one = df.agg(F.regr_slope(Y, X).alias("slope"), F.regr_intercept(Y, X).alias("intercept"),
                 F.min(X).alias("lo"), F.max(X).alias("hi"))
    g = one.select("*", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("i"))
    gx = F.col("lo") + F.col("i") * (F.col("hi") - F.col("lo")) / (steps - 1)
    return g.select("i", gx.alias("x"), (F.col("intercept") + F.col("slope") * gx).alias("y_hat"))


def cubic(df: DataFrame, x: str, y: str):
    """Cubic polynomial fit y ~ x + x² + x³ (trend_cubic; a B-spline basis
    with 3 degrees of freedom and no interior knots spans the same space)."""
    X = F.col(x).cast("double")
    return fit(df, F.col(y), [term("x1", X), term("x2", X * X), term("x3", X * X * X)])
