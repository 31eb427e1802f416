"""Least-squares identities and a numpy cross-check."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SMALL
from tipscope.catalog.base import analysis
from tipscope.operators import diagnostics as dia
from tipscope.operators import filters as flt
from tipscope.operators import regression as reg
from tipscope.plans import flows


def _clean(spark):
    return flt.model_clean(analysis(spark, SMALL))


def test_final_model_matches_numpy(spark):
    c = _clean(spark)
    spec = flows.MODELS["log_final"]
    f = flows.fit_model(c, spec)
    pdf = c.select("tip_amount", "fare_amount", "extra").toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.fare_amount, pdf.fare_amount ** 2, pdf.extra])
    beta, *_ = np.linalg.lstsq(X, np.log(pdf.tip_amount), rcond=None)
    got = np.array([f.intercept, *f.beta])
    assert np.allclose(got, beta, rtol=1e-7, atol=1e-10)


def test_residuals_orthogonal_and_mean_leverage(spark):
    c = _clean(spark)
    spec = flows.MODELS["log_full"]
    f = flows.fit_model(c, spec)
    infl = dia.influence(c, flows.response(spec), spec.terms, f)
    sums = infl.agg(F.sum("resid"), F.sum(F.col("resid") * F.col("fare_amount")),
                    F.avg("leverage")).first()
    assert abs(sums[0]) < 1e-7 and abs(sums[1]) < 1e-5
    assert abs(sums[2] - f.n_params / f.n) < 1e-9


def test_cooks_distance_equals_leave_one_out(spark):
    c = _clean(spark).orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").limit(30)
    c = spark.createDataFrame(c.toPandas())
    terms = [reg.term("fare_amount"), reg.term("extra")]
    y = F.ln("tip_amount")
    f = reg.fit(c, y, terms)
    infl = dia.influence(c, y, terms, f, keep=["l_orderkey", "l_linenumber"]).toPandas()
    pdf = c.toPandas()
    X = np.column_stack([np.ones(len(pdf)), pdf.fare_amount, pdf.extra])
    yy = np.log(pdf.tip_amount.values)
    full = X @ np.linalg.lstsq(X, yy, rcond=None)[0]
    s2 = f.sigma2
    for i in range(5):
        keep = np.arange(len(pdf)) != i
        b = np.linalg.lstsq(X[keep], yy[keep], rcond=None)[0]
        d = np.sum((full - X @ b) ** 2) / (3 * s2)
        row = infl[(infl.l_orderkey == pdf.l_orderkey[i]) & (infl.l_linenumber == pdf.l_linenumber[i])]
        assert abs(row.cooks_d.iloc[0] - d) < 1e-8


def test_vif_at_least_one(spark):
    f = flows.fit_model(_clean(spark), flows.MODELS["log_final"])
    assert all(r.vif >= 1 - 1e-12 for r in reg.vif(spark, f).collect())


def test_t_and_f_p_values_in_range(spark):
    f = flows.fit_model(_clean(spark), flows.MODELS["log_final"])
    for _, b, se, t, p in f.coefficients():
        assert 0 <= p <= 1
    assert 0 <= f.stats()["f_p_value"] <= 1


def test_gvif_single_terms_equal_vif(spark):
    f = flows.fit_model(_clean(spark), flows.MODELS["log_final"])
    v = {r.term: r.vif for r in reg.vif(spark, f).collect()}
    g = {r.term: r.gvif for r in reg.gvif(spark, f, {t: [t] for t in f.terms}).collect()}
    for t in f.terms:
        assert abs(v[t] - g[t]) < 1e-6 * v[t]
