"""Local fits and penalised splines against the formulas applied to every row."""

import math

import numpy as np
import pytest

from tipscope.operators import smooth


def local_fit(x, y, x0, span=0.75):
    d = np.abs(x - x0)
    h = np.sort(d)[max(int(len(x) * span), 1) - 1]
    near = d < h
    if len(np.unique(x[near])) < 3:
        return None
    w = np.sqrt((1 - (d[near] / h) ** 3) ** 3)
    t = (x[near] - x0) / h
    b = np.linalg.lstsq(np.column_stack([w, w * t, w * t * t]), w * y[near], rcond=None)[0]
    return float(b[0])


def made():
    r = np.random.default_rng(4)
    rows = [("ties", float(v), math.sin(v) + float(r.normal())) for v in r.integers(0, 30, 400)]
    rows += [(None, float(v), float(v * v + r.normal())) for v in r.gamma(1.5, 4, 300)]
    rows += [("far", float(v), float(r.normal())) for v in np.r_[r.normal(size=200), 9.0, -7.0]]
    rows += [("two", 1.0, 2.0), ("two", 2.0, 3.0), ("one", 5.0, 1.0), ("one", 5.0, 3.0)]
    rows += [("ties", None, 1.0), ("ties", 3.0, None), ("none", float("nan"), 1.0), ("far", float("inf"), 1.0)]
    return rows


@pytest.mark.parametrize("steps,short,span", [(None, 0, .75), (None, 500, .75), (25, 0, .3), (25, 500, 1.0), (25, 0, 1.0)])
def test_local_fits(spark, steps, short, span):
    rows = made()
    df = spark.createDataFrame(rows, "g string, x double, y double").repartition(3)
    got = {}
    for r in smooth.loess(df, "x", "y", "g", span, steps, short, range_rows=150).collect():
        assert (r.g, r.x) not in got
        got[r.g, r.x] = r.fitted
    assert {g for g, _ in got} == {"ties", None, "far", "two", "one"}
    for g in ("ties", None, "far", "two", "one"):
        x, y = np.array([(a, b) for k, a, b in rows if k == g and a is not None and b is not None and abs(a) < math.inf]).T
        at = np.unique(x) if steps is None else np.unique(x.min() + np.arange(steps) * (x.max() - x.min()) / (steps - 1))
        assert sorted(v for k, v in got if k == g) == pytest.approx(list(at))
        for (k, v), f in got.items():
            if k == g:
                want = local_fit(x, y, v, span)
                assert (f is None) == (want is None), (k, v)
                assert f is None or f == pytest.approx(want, rel=1e-6, abs=1e-6), (k, v)


def test_a_cluster_far_from_the_target_determines_nothing(spark):
    rows = [(i / 1e4, float(i % 7)) for i in range(300)] + [(4000.0, 2.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    for short in (0, 500):
        fits = [r.fitted for r in smooth.loess(df, "x", "y", steps=4, short=short).collect()]
        assert len(fits) == 4 and sum(f is None for f in fits) == 3


def test_points_are_not_joined_with_points(spark):
    df = spark.range(3000).selectExpr("id / 7.0D AS x", "sin(id / 500.0D) AS y")
    out = smooth.loess(df, "x", "y", steps=10, range_rows=400)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan
    x = np.arange(3000) / 7.0
    for r in out.collect():
        assert r.fitted == pytest.approx(local_fit(x, np.sin(np.arange(3000) / 500.0), r.x), abs=1e-8)


def test_without_points(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert smooth.loess(df, "x", "y").count() == 0 and smooth.loess(df, "x", "y", steps=5, short=-1).count() == 0
    assert smooth.spline(df, "x", "y").count() == 0
    with pytest.raises(ValueError):
        smooth.loess(df, "x", "y", span=0)


def test_spline_solves_the_penalised_system(spark):
    r = np.random.default_rng(8)
    x = np.r_[r.gamma(2, 5, 700), 90.0]  # most parts of the range hold no point
    y = 1000 + np.sin(x / 4) + r.normal(scale=.2, size=len(x))
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, float("nan"))]
    got = sorted(smooth.spline(spark.createDataFrame(rows, "x double, y double"), "x", "y", 12, 30).collect())
    basis = smooth.bumps((x - x.min()) / ((x.max() - x.min()) / 12), 12)
    assert np.allclose(basis.sum(1), 1)
    z = y - y.mean()
    _, weight, edf = smooth.penalised(basis.T @ basis, basis.T @ z, z @ z, len(z))
    rough = np.diff(np.eye(15), 2, axis=0)
    b = np.linalg.lstsq(np.vstack([basis, math.sqrt(weight) * rough]), np.r_[z, np.zeros(13)], rcond=None)[0]
    want = smooth.bumps(np.linspace(0, 12, 30), 12) @ b + y.mean()
    assert [p.i for p in got] == list(range(30)) and got[0].x == x.min() and got[-1].x == pytest.approx(x.max())
    assert [p.y_hat for p in got] == pytest.approx(list(want), abs=1e-6)
    assert 2 < edf < 15 and all(p.edf == pytest.approx(edf, rel=1e-6) for p in got)


def test_spline_keeps_a_line_and_a_constant(spark):
    line = spark.range(200).selectExpr("cast(id AS double) AS x", "3.0D * id - 7 AS y")
    assert all(p.y_hat == pytest.approx(3 * p.x - 7, abs=1e-5) for p in smooth.spline(line, "x", "y").collect())
    same = spark.createDataFrame([(2.0, 1.0), (2.0, 4.0)], "x double, y double")
    assert [tuple(p) for p in smooth.spline(same, "x", "y").collect()] == [(0, 2.0, 2.5, 1.0)]
