"""Results keep every row, bin and pair on hand-made tables."""

from statistics import NormalDist

import pytest

from tipscope.operators import binning as bn
from tipscope.operators import correlation as cor
from tipscope.operators import diagnostics as dia
from tipscope.operators import trends

NAN = float("nan")


def test_qq_has_every_row(spark):
    n = 3000
    values = [((i * 7919) % n) / 7 for i in range(n)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (NAN,)], "std_resid double")
    got = sorted((r.i, r.p, r["sample"], r.theoretical) for r in dia.qq(df).collect())
    assert [g[0] for g in got] == list(range(1, n + 1))
    assert [g[2] for g in got] == sorted(values)
    for i, p, _, z in got[::97]:
        assert p == pytest.approx((i - 0.5) / n) and z == pytest.approx(NormalDist().inv_cdf(p))


def test_qq_of_few_rows_and_of_none(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "std_resid double")
    assert sorted(r.p for r in dia.qq(df).collect()) == pytest.approx([0.625 / 2.25, 1.625 / 2.25])
    assert dia.qq(df.where("std_resid > 9")).count() == 0


def test_empty_bins_are_given(spark):
    df = spark.createDataFrame([(0.0,), (10.0,), (10.0,), (None,), (NAN,)], "x double")
    got = sorted((r.bin, r.n) for r in bn.hist_equal(df, "x", 10).collect())
    assert got == [(0, 1), *[(i, 0) for i in range(1, 9)], (9, 2)]
    pretty = sorted((r.bin, r.break_lo, r.break_hi, r.n) for r in bn.hist_pretty(df, "x").collect())
    assert sum(r[3] for r in pretty) == 3 and [r[0] for r in pretty] == list(range(1, len(pretty) + 1))
    assert pretty[0][1] == 0 and pretty[-1][2] >= 10
    assert bn.hist_equal(df.where("x is null"), "x", 10).count() == 0


def test_grid_spans_complete_pairs(spark):
    df = spark.createDataFrame([(0.0, 1.0), (4.0, 3.0), (100.0, None), (None, 5.0)], "x double, y double")
    got = sorted((r.x, r.y_hat) for r in trends.lm_grid(df, "x", "y", 5).collect())
    assert got == [pytest.approx(p) for p in ((0, 1), (1, 1.5), (2, 2), (3, 2.5), (4, 3))]


def test_nan_is_missing_in_correlations(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (NAN, 1.0), (7.0, None)], "a double, b double")
    got = {(r.var_x, r.var_y): r.r for r in cor.matrix(df, ["a", "b"]).collect()}
    assert all(v == pytest.approx(1.0) for v in got.values()) and len(got) == 4
