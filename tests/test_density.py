"""Binned densities against the sum over all values."""

import math

import numpy as np
import pytest

from tipscope.operators import binning as bn


def exact(x, n_grid, cut=3.0):
    q1, q3 = np.quantile(x, [.25, .75])
    bw = 0.9 * min(x.std(ddof=1), (q3 - q1) / 1.34) * len(x) ** -0.2
    g = np.linspace(x.min() - cut * bw, x.max() + cut * bw, n_grid)
    return g, np.exp(-0.5 * ((g[:, None] - x) / bw) ** 2).sum(1) / (len(x) * bw * math.sqrt(2 * math.pi)), bw


@pytest.mark.parametrize("bins", [1000, 16_384])
def test_error_is_within_the_bound(spark, bins):
    r = np.random.default_rng(6)
    rows = [("a", float(v)) for v in r.gamma(2, 3, 3000)] + [(None, float(v)) for v in np.r_[r.normal(size=500), 60.0]]
    rows += [("a", None), ("a", float("nan")), ("none", None)]
    got = {}
    for d in bn.kde(spark.createDataFrame(rows, "g string, x double"), "x", "g", bins=bins).collect():
        got.setdefault(d.g, []).append(d)
    assert set(got) == {"a", None}
    for g, points in got.items():
        points.sort(key=lambda d: d.i)
        x = np.array([v for k, v in rows if k == g and v is not None and v == v])
        grid, want, bw = exact(x, 512)
        assert [d.i for d in points] == list(range(512)) and [d.x for d in points] == pytest.approx(list(grid))
        step = -(-bins // 511)
        bound = ((grid[-1] - grid[0]) / (511 * step) / bw) ** 2 / 8 / (bw * math.sqrt(2 * math.pi))
        assert np.abs(np.array([d.density for d in points]) - want).max() <= bound + 1e-12
        mass = np.trapezoid([d.density for d in points], grid)
        assert mass == pytest.approx(1, abs=5e-3)


def test_the_default_is_the_sum_over_all_values(spark):
    r = np.random.default_rng(8)
    rows = [("a", 1, float(v)) for v in np.r_[r.normal(size=900), np.repeat(40.0, 20), -1e3]]
    rows += [(None, None, float(v)) for v in r.gamma(2, 3, 700)] + [(None, 2, float(v)) for v in r.normal(size=30)] + [("b", 1, None)]
    got = {}
    for d in bn.kde(spark.createDataFrame(rows, "g string, h int, x double"), "x", ["g", "h"]).collect():
        got.setdefault((d.g, d.h), []).append(d)
    assert set(got) == {("a", 1), (None, None), (None, 2)}
    for key, points in got.items():
        points.sort(key=lambda d: d.i)
        grid, want, _ = exact(np.array([v for g, h, v in rows if (g, h) == key]), 512)
        assert [d.x for d in points] == pytest.approx(list(grid))
        assert np.abs(np.array([d.density for d in points]) - want).max() < 1e-12


def test_shuffled_rows_are_bounded_by_the_grid(spark):
    df = spark.range(200_000).selectExpr("sqrt(id) AS x")
    out = bn.kde(df, "x", bins=2000)
    assert out.count() == 512
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_degenerate_groups_have_a_bandwidth(spark):
    df = spark.createDataFrame([("same", 4.0)] * 5 + [("zero", 0.0)] * 3 + [("one", -2.0)], "g string, x double")
    got = {}
    for d in bn.kde(df, "x", "g", n_grid=16).collect():
        got.setdefault(d.g, []).append(d)
    assert {g: round(v[0].bw, 6) for g, v in got.items()} == {
        "same": round(0.9 * 4 * 5 ** -0.2, 6), "zero": round(0.9 * 3 ** -0.2, 6), "one": 1.8}
    assert all(len(v) == 16 and all(d.density >= 0 for d in v) for v in got.values())
    assert bn.kde(df.where("x > 99"), "x", "g").count() == 0
