"""Blocked cross-products, correlations and fits against numpy."""

from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tipscope.functions.distributions import normal_quantile
from tipscope.operators import correlation as cor
from tipscope.operators import diagnostics as dia
from tipscope.operators import factors as fac
from tipscope.operators import moments as mo
from tipscope.operators import regression as reg


def frame(spark, x, names, parts=5):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(parts)


@pytest.fixture(scope="module")
def gappy():
    r = np.random.default_rng(7)
    x = r.normal(size=(900, 15)) * 10.0 ** r.integers(-2, 4, 15) + 1e6 * r.integers(0, 2, 15)
    x[:, 3] = x[:, 1] + r.normal(size=900)
    x[r.random(x.shape) < 0.2] = np.nan
    x[:, 9] = 1.75
    return x


def test_pairwise_complete_correlations(spark, gappy, monkeypatch):
    monkeypatch.setattr(mo, "BLOCK", 50)  # many merges
    names = [f"v{i}" for i in range(gappy.shape[1])]
    df = frame(spark, gappy, names)
    got = {(r.var_x, r.var_y): r for r in mo.pairwise(df, names).collect()}
    r = {(x.var_x, x.var_y): x.r for x in cor.matrix(df, names).collect()}
    assert len(got) == len(r) == 225
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(gappy[:, i]) & ~np.isnan(gappy[:, j])
            x, y = gappy[both, i], gappy[both, j]
            m = got[a, b]
            assert m.n == both.sum() and m.mean_x == pytest.approx(x.mean(), rel=1e-12)
            assert m.m2_y == pytest.approx(((y - y.mean()) ** 2).sum(), rel=1e-9, abs=1e-12)
            if 9 in (i, j):
                assert r[a, b] is None
            else:
                assert r[a, b] == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    assert len(cor.matrix(df, names, upper=True).collect()) == 120


def test_no_row_is_unfolded(spark, gappy):
    df = frame(spark, gappy, [f"v{i}" for i in range(15)])
    plan = cor.matrix(df, [f"v{i}" for i in range(15)])._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Expand" not in plan


def test_an_empty_table_has_null_correlations(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "a double, b double")
    assert {(r.var_x, r.var_y, r.r) for r in cor.matrix(df, ["a", "b"], upper=True).collect()} == {
        ("a", "a", None), ("a", "b", None), ("b", "b", None)}
    assert all(r.r is None for r in cor.matrix(df.where("a > 9"), ["a", "b"]).collect())


def test_dummies_of_the_whole_frame(spark):
    r = np.random.default_rng(2)
    rows = [(float(r.normal()), str(r.choice(list("xyz"))), bool(r.random() < .4), f"id{i}") for i in range(300)] + [(1.0, None, None, "q")]
    df = spark.createDataFrame(rows, "v double, c string, b boolean, many string")
    got = {(x.var_x, x.var_y): x.r for x in cor.with_dummies(df).collect()}
    assert {a for a, _ in got} == {"v", "c_x", "c_y", "c_z", "b_false", "b_true"} and len(got) == 21
    v = np.array([x[0] for x in rows[:-1]])
    y = np.array([x[1] == "y" for x in rows[:-1]], float)
    assert got["v", "c_y"] == pytest.approx(np.corrcoef(v, y)[0, 1])
    assert got["b_false", "b_true"] == pytest.approx(-1)


def test_a_wide_fit_and_several_models_in_one_pass(spark, gappy):
    names = [f"v{i}" for i in range(15) if i != 9]
    x = gappy[:, [i for i in range(15) if i != 9]]
    df = frame(spark, x, names)
    models = [(F.col("v0"), [reg.term(n) for n in names[1:]]), (F.col("v1"), [reg.term("v4"), reg.term("v5")])]
    for f, at in zip(reg.fit_many(df, models), ((0, range(1, 14)), (1, (4, 5)))):
        y, cols = at
        z = x[~np.isnan(x[:, [y, *cols]]).any(1)]
        X = np.column_stack([np.ones(len(z)), z[:, list(cols)]])
        X = (X - np.r_[0, X[:, 1:].mean(0)])
        beta = np.linalg.lstsq(X, z[:, y], rcond=None)[0]
        assert f.n == len(z) and np.allclose(f.beta, beta[1:], rtol=1e-6)
        assert f.rss == pytest.approx(((z[:, y] - X @ beta) ** 2).sum(), rel=1e-8)


def test_aliased_terms_cost_no_degree_of_freedom(spark):
    r = np.random.default_rng(1)
    a, b = r.normal(size=200), r.normal(size=200) * 3 + 1000
    y = a + b / 2 + r.normal(size=200)
    df = frame(spark, np.column_stack([a, b, 2 * a - b, np.full(200, 1.75), y]), ["a", "b", "c", "k", "y"])
    f = reg.fit(df, F.col("y"), [reg.term(n) for n in ("a", "k", "b", "c")])
    X = np.column_stack([np.ones(200), a, b])
    beta, rss = np.linalg.lstsq(X, y, rcond=None)[:2]
    got = {t: (e, s, q, p) for t, e, s, q, p in f.coefficients()}
    assert got["k"] == got["c"] == (None,) * 4 and f.n_params == 3 and f.df_resid == 197
    assert [got[t][0] for t in ("(Intercept)", "a", "b")] == pytest.approx(beta)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * rss[0] / 197)
    assert [got[t][1] for t in ("(Intercept)", "a", "b")] == pytest.approx(se, rel=1e-6)
    assert reg.coef_table(spark, f).where("estimate IS NULL").count() == 2
    assert {r.term: r.vif is None for r in reg.vif(spark, f).collect()} == {"a": False, "k": True, "b": False, "c": True}
    fitted = np.array([r.fitted for r in reg.with_fit(df, F.col("y"), [reg.term(n) for n in ("a", "k", "b", "c")], f).collect()])
    assert np.isfinite(fitted).all()
    infl = dia.influence(df, F.col("y"), [reg.term(n) for n in ("a", "k", "b", "c")], f).agg(F.sum("leverage")).first()[0]
    assert infl == pytest.approx(3)


def test_a_whole_set_of_dummies_loses_one(spark):
    rows = [(float(i % 7), "abc"[i % 3], "one") for i in range(60)] + [(1.0, None, "one")]
    df = spark.createDataFrame(rows, "y double, g string, h string")
    full = [reg.term(f"g{v}", (F.col("g") == v).cast("double")) for v in "abc"]
    f = reg.fit(df, F.col("y"), full)
    assert f.n == 60 and f.live == [0, 1] and f.df_resid == 57
    terms, blocks = fac.terms(df, ["g", "h"], ["g", "h"], {"g": ["b", "a", "c"]})
    assert [n for n, _ in terms] == ["g_a", "g_c"] and blocks == {"g": ["g_a", "g_c"], "h": []}


def test_a_factor_is_one_column_of_the_pass(spark, monkeypatch):
    r = np.random.default_rng(4)
    rows = [(float(r.normal()), float(i % 9), "abc"[i % 3], None if i % 31 == 0 else i % 4) for i in range(400)]
    rows += [(1.0, 2.0, None, 1), (None, 1.0, "a", 1)]
    df = spark.createDataFrame(rows, "y double, x double, g string, h int").repartition(3)
    terms, _ = fac.terms(df, ["x", "g", "h"], ["g", "h"], {"g": ["b", "a"]})
    width, reduce = [], mo.tree_reduce
    monkeypatch.setattr(mo, "tree_reduce", lambda d, *a: width.append(len(d.columns)) or reduce(d, *a))
    monkeypatch.setattr(mo, "BLOCK", 50)
    fits = reg.fit_many(df, [(F.col("y"), terms), (F.col("y"), terms[:2])])
    assert width == [5]  # twice y, x, g, h
    plain = reg.fit_many(df, [(F.col("y"), [reg.term(*t) for t in terms]), (F.col("y"), [reg.term(*t) for t in terms[:2]])])
    assert width == [5, 2 + len(terms)] and len(terms) == 6
    for a, b in zip(fits, plain):
        assert a.n == b.n and a.live == b.live and np.allclose(a.sxx, b.sxx) and np.allclose(a.beta, b.beta, equal_nan=True)


def test_a_fit_of_no_rows(spark):
    df = spark.createDataFrame([(1.0, None)], "y double, x double")
    f = reg.fit(df, F.col("y"), [reg.term("x")])
    assert f.n == 0 and all(v is None for _, *rest in f.coefficients() for v in rest)


def test_normal_quantile_column(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.07, 0.075, 0.3, 0.5, 0.8, 0.9251, 1 - 1e-9]
    df = spark.createDataFrame([(v,) for v in [*p, 0.0, 1.0, None]], "p double")
    got = {r.p: r.z for r in df.select("p", normal_quantile(F.col("p")).alias("z")).collect()}
    assert got[0.0] is None and got[1.0] is None
    for v in p:
        assert got[v] == pytest.approx(NormalDist().inv_cdf(v), rel=1e-9, abs=1e-12)


def test_top_by_measure_takes_ties_by_key_and_missing_last(spark):
    rows = [(i, float(-(i % 5)), None if i % 2 else 1.0, float("nan") if i < 15 else 2.0) for i in range(20)]
    df = spark.createDataFrame(rows, "k long, cooks_d double, rstudent double, leverage double")
    got = {}
    for r in dia.top_by_measure(df, ["k"], 3).collect():
        got.setdefault(r.measure, set()).add(r.k)
    assert got == {"cooks_d": {4, 9, 14}, "rstudent": {0, 2, 4}, "leverage": {15, 16, 17}}
