"""Registered correlation, regression, diagnostics and flow queries
(SURVEY §2.7, §2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tipscope import oracle
from tipscope.catalog import factor_sql as fsql
from tipscope.catalog.base import FRAME_NUMERIC, FRAME_STRING, SELECTED, all_features, analysis, register, signif_sql, trips, zones
from tipscope.catalog.basics import FEAT_DOUBLES, KEY, TRIP_DOUBLES
from tipscope.catalog.ols_sql import influence_ctes, ols_ctes
from tipscope.functions import distributions as dist
from tipscope.operators import correlation as cor
from tipscope.operators import diagnostics as dia
from tipscope.operators import factors as fac
from tipscope.operators import filters as flt
from tipscope.operators import regression as reg
from tipscope.operators import trends
from tipscope.plans import flows
from tipscope.plans.features import add_features
from tipscope.sources.fixtures import TRIP_KEY

# ---------------------------------------------------------------- correlation


def _pair_sql(a, b):
    xa = f"CASE WHEN {b} IS NOT NULL THEN CAST({a} AS DOUBLE) END"
    xb = f"CASE WHEN {a} IS NOT NULL THEN CAST({b} AS DOUBLE) END"
    return f"covar_pop({xa}, {xb}) / nullif(stddev_pop({xa}) * stddev_pop({xb}), 0)"


def _matrix_sql(cols, src="feat", upper=False):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i:]:
            e = _pair_sql(a, b)
            parts.append(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {e} AS r FROM {src}")
            if not upper and a != b:
                parts.append(f"SELECT '{b}' AS var_x, '{a}' AS var_y, {e} AS r FROM {src}")
    return "\nUNION ALL ".join(parts)


register("cor_matrix", lambda s, d: cor.matrix(analysis(s, d), cor.COR_VARS),
         _matrix_sql(cor.COR_VARS), ["feat"], ["r"])
register("cor_upper", lambda s, d: cor.matrix(analysis(s, d), cor.COR_VARS, upper=True),
         _matrix_sql(cor.COR_VARS, upper=True), ["feat"], ["r"])


def _dummies(s, d):
    return cor.with_dummies(analysis(s, d), exclude=TRIP_KEY)


def _dummies_sql():
    numeric = ", ".join(f"({i}, 0, '{c}', CAST({c} AS DOUBLE))" for i, c in enumerate(FRAME_NUMERIC))
    lv = " UNION ALL ".join(f"SELECT {100 + i} AS block, '{c}' AS variable, {c} AS lev FROM feat WHERE {c} IS NOT NULL"
                            for i, c in enumerate(FRAME_STRING))
    own = " ".join(f"WHEN '{c}' THEN {c}" for c in FRAME_STRING)
    return {
        "numbered": "SELECT *, row_number() OVER () AS rid FROM feat",
        "lev": f"SELECT *, count(*) OVER (PARTITION BY variable) AS size, row_number() OVER (PARTITION BY variable ORDER BY lev) AS r "
               f"FROM (SELECT DISTINCT * FROM ({lv}) a) b",
        "cells": f"SELECT rid, block, r, name, v FROM numbered, (VALUES {numeric}) t(block, r, name, v) UNION ALL "
                 f"SELECT rid, block, r, variable || '_' || lev, CAST(CASE variable {own} END = lev AS DOUBLE) "
                 f"FROM numbered, lev WHERE size <= 20",
        "pairs": "SELECT a.name AS var_x, b.name AS var_y, a.v AS x, b.v AS y FROM cells a JOIN cells b ON a.rid = b.rid "
                 "AND (a.block, a.r) <= (b.block, b.r) WHERE a.v IS NOT NULL AND b.v IS NOT NULL"}


register("cor_dummies", _dummies,
         "SELECT var_x, var_y, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM pairs GROUP BY 1, 2",
         ["feat"], ["r"], _dummies_sql())

RANK_VARS = tuple(c for c in cor.COR_VARS if c != "tip_amount")
register(
    "cor_rank_target",
    lambda s, d: cor.rank_target(analysis(s, d), "tip_amount", RANK_VARS),
    "SELECT variable, r, abs(r) AS abs_r, row_number() OVER (ORDER BY abs(r) DESC NULLS LAST,"
    " variable) AS rank FROM (" + "\nUNION ALL ".join(
        f"SELECT '{c}' AS variable, {_pair_sql(c, 'tip_amount')} AS r FROM feat"
        for c in RANK_VARS) + ") q", ["feat"], ["r", "abs_r"])

# ---------------------------------------------------------------- models
SQL_TERMS = {
    "raw": ("tip_amount", [("fare_amount", "fare_amount"), ("fare_sq", "fare_amount * fare_amount"),
                           ("trip_distance", "trip_distance"), ("extra", "extra"),
                           ("trip_minutes", "trip_minutes")]),
    "log_full": ("ln(tip_amount)", [("fare_amount", "fare_amount"),
                                    ("fare_sq", "fare_amount * fare_amount"),
                                    ("trip_distance", "trip_distance"), ("extra", "extra"),
                                    ("trip_minutes", "trip_minutes")]),
    "log_final": ("ln(tip_amount)", [("fare_amount", "fare_amount"),
                                     ("fare_sq", "fare_amount * fare_amount"), ("extra", "extra")]),
    "log_interact": ("ln(tip_amount)", [("fare_amount", "fare_amount"),
                                        ("fare_sq", "fare_amount * fare_amount"),
                                        ("extra", "extra"),
                                        ("fare_x_extra", "fare_amount * extra")]),
}


def _ctes(model, keys=TRIP_KEY, src="mclean"):
    y, terms = SQL_TERMS[model]
    return ols_ctes(model, src, y, terms, keys)


def clean(s, d):
    return flt.model_clean(analysis(s, d))


def _fit(s, d, model):
    c = clean(s, d)
    return c, flows.fit_model(c, flows.MODELS[model])


def _coef(model):
    def fn(s, d):
        _, f = _fit(s, d, model)
        return reg.coef_table(s, f, model).select("term", "estimate")
    return fn


for _m, _id in (("raw", "mod_ols_raw"), ("log_full", "mod_ols_log_full"),
                ("log_final", "mod_ols_log_final"), ("log_interact", "mod_ols_interact")):
    register(_id, _coef(_m), f"SELECT * FROM {_m}_coef", ["mclean"], ["estimate"], _ctes(_m))


def _gram(s, d):
    spec = flows.MODELS["log_final"]
    g = reg.gram_long(clean(s, d), flows.response(spec), spec.terms)
    return g.withColumn("value", reg.signif(F.col("value"), 10))


def _gram_sql():
    cols = [("1", "1.0"), ("fare_amount", "fare_amount"), ("fare_sq", "fare_amount * fare_amount"),
            ("extra", "extra"), ("y", "ln(tip_amount)")]
    parts = []
    for i, (a, ea) in enumerate(cols):
        for b, eb in cols[i:]:
            parts.append(f"SELECT '{a}' AS row_term, '{b}' AS col_term, "
                         f"{signif_sql(f'sum(CAST({ea} AS DOUBLE) * CAST({eb} AS DOUBLE))')}"
                         f" AS value FROM mclean")
    return "\nUNION ALL ".join(parts)


register("mod_gram", _gram, _gram_sql(), ["mclean"], ["value"])


def _typical(s, d):
    t = flt.band_trim(analysis(s, d), TYPICAL_BAND).where(F.col("tip_amount") > 0)
    tot = F.col("total_amount")
    return reg.coef_table(s, reg.fit(t, F.ln("tip_amount"),
                                     [reg.term("total_amount"), reg.term("total_sq", tot * tot),
                                      reg.term("extra")]), "typical").select("term", "estimate")


# The columns of the bands, taken over all rows of the table
TYPICAL_BAND = ("fare_amount", "total_amount", "trip_distance", "trip_minutes", "tip_pct")
TYPICAL_SRC = {"band": "SELECT f.* FROM feat f, (SELECT "
               + ", ".join(f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}"
                           for c in TYPICAL_BAND)
               + " FROM feat) b WHERE f.tip_amount > 0 AND "
               + " AND ".join(f"f.{c} BETWEEN b.lo_{c} AND b.hi_{c}" for c in TYPICAL_BAND)}
register("mod_typical", _typical, "SELECT * FROM typ_coef", ["feat"], ["estimate"],
         {**TYPICAL_SRC, **ols_ctes("typ", "band", "ln(tip_amount)",
                                    [("total_amount", "total_amount"),
                                     ("total_sq", "total_amount * total_amount"),
                                     ("extra", "extra")])})


# The predictors of the notebooks' factor models. "draft" is fitted on
# all trips, "final" on the selected ones, where hour and month are numbers;
# "final_factors" takes these as factors too
FACTOR_MODELS = {
    "draft": (("fare_amount", "trip_distance", "trip_minutes", "pickup_hour", "pickup_weekday_name", "passenger_count",
               "payment_type", "extra", "file_month"), ("pickup_weekday_name", "payment_type", "file_month")),
    "final": (("fare_amount", "trip_distance", "trip_minutes", "pickup_hour", "pickup_weekday_name", "extra", "month"),
              ("pickup_weekday_name",)),
    "final_factors": (("fare_amount", "trip_distance", "trip_minutes", "pickup_hour", "pickup_weekday_name",
                       "payment_type", "extra", "month"),
                      ("pickup_hour", "pickup_weekday_name", "payment_type", "month")),
}
WEEKDAYS = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")


def _factor_fits(s, d):
    """(model, fit, blocks) of each: one pass over all trips, one over the selected
    ones."""
    out = []
    for df, models in ((all_features(s, d), ["draft"]), (analysis(s, d), ["final", "final_factors"])):
        made = [fac.terms(df, *FACTOR_MODELS[m], {"pickup_weekday_name": WEEKDAYS}) for m in models]
        fits = reg.fit_many(df, [(F.col("tip_amount"), terms) for terms, _ in made])
        out += zip(models, fits, [blocks for _, blocks in made])
    return out


def _factor_ctes(model):
    predictors, factors = FACTOR_MODELS[model]
    order = {c: f"list_position({list(WEEKDAYS)}, lev)" if c == "pickup_weekday_name" else "lev" for c in factors}
    src = "tfeat" if model == "draft" else "feat"
    return {**fsql.design_ctes(model, src, "tip_amount", predictors, order), **fsql.sweep_ctes(model)}


def _all_factor_ctes():
    return {k: v for m in FACTOR_MODELS for k, v in _factor_ctes(m).items()}


def _union(frames):
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _factors(s, d):
    return _union([reg.coef_table(s, f, m) for m, f, _ in _factor_fits(s, d)])


def _coef_sql(models, where="TRUE"):
    """Estimates, errors, t and their degrees of freedom as a beta argument."""
    return "\nUNION ALL ".join(
        f"""SELECT '{m}' AS model, term, estimate, sqrt(v * rss / (n - rank)) AS std_error,
       estimate / sqrt(v * rss / (n - rank)) AS t_value, (n - rank) / 2.0 AS a, 0.5 AS b,
       (n - rank) / ((n - rank) + estimate * estimate / (v * rss / (n - rank))) AS x, rss, syy, n, rank FROM {m}_fit"""
        for m in models)


register("mod_ols_factors", _factors, "SELECT model, term, estimate, std_error, t_value, p_value FROM pv",
         ["feat", "tfeat"], ["estimate", "std_error", "t_value", "p_value"],
         {**_all_factor_ctes(), "coefs": _coef_sql(FACTOR_MODELS), **fsql.beta_ctes("pv", "coefs")})


def _gvif(s, d):
    return _union([reg.gvif(s, f, blocks).select(F.lit(m).alias("model"), "*") for m, f, blocks in _factor_fits(s, d)])


def _gvif_sql():
    return "\nUNION ALL ".join(
        f"SELECT '{m}' AS model, CASE block " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(FACTOR_MODELS[m][0], 1))
        + f" END AS term, gvif, df, gvif_scaled FROM {m}_gv" for m in FACTOR_MODELS)


register("mod_gvif", _gvif, _gvif_sql(), ["feat", "tfeat"], ["gvif", "gvif_scaled"],
         {**_all_factor_ctes(), **{k: v for m in FACTOR_MODELS for k, v in fsql.determinant_ctes(m).items()}})

# ---------------------------------------------------------------- whole summaries
SUMMARISED = ("raw", "log_full", "log_final")


def _plain_ctes(model):
    y, terms = SQL_TERMS[model]
    src = {f"{model}_src": f"SELECT {y} AS _resp, " + ", ".join(f"{e} AS {n}" for n, e in terms) + " FROM mclean"}
    return {**src, **fsql.design_ctes(model, f"{model}_src", "_resp", [n for n, _ in terms], {}), **fsql.sweep_ctes(model)}


def _fits(s, d, models):
    c = clean(s, d)
    specs = [flows.MODELS[m] for m in models]
    return reg.fit_many(c, [(flows.response(sp), sp.terms) for sp in specs])


def _summary(s, d):
    out = []
    for m, f in zip(SUMMARISED, _fits(s, d, SUMMARISED)):
        st = reg.stats_table(s, f, m).drop("rss", "n_params")
        out.append(reg.coef_table(s, f, m).join(F.broadcast(st), "model"))
    return _union(out)


def _ftest_sql(models):
    return "\nUNION ALL ".join(
        f"""SELECT '{m}' AS model, n, 1 - rss / syy AS r_squared, 1 - (rss / syy) * (n - 1) / (n - rank) AS adj_r_squared,
       sqrt(rss / (n - rank)) AS sigma, ((syy - rss) / (rank - 1)) / (rss / (n - rank)) AS f_stat, rank - 1 AS df1,
       n - rank AS df2, (n - rank) / 2.0 AS a, (rank - 1) / 2.0 AS b,
       (n - rank) / ((n - rank) + (syy - rss) / (rss / (n - rank))) AS x FROM {m}_fit WHERE k = 1""" for m in models)


SUMMARY_CTES = {**{k: v for m in SUMMARISED for k, v in _plain_ctes(m).items()},
                "coefs": _coef_sql(SUMMARISED), **fsql.beta_ctes("pv", "coefs"),
                "ftest": _ftest_sql(SUMMARISED), **fsql.beta_ctes("fv", "ftest")}
register("mod_summary", _summary,
         """SELECT p.model, term, estimate, std_error, t_value, p.p_value, CAST(f.n AS BIGINT) AS n, r_squared, adj_r_squared,
                   sigma, f_stat, CAST(df1 AS BIGINT) AS df1, CAST(df2 AS BIGINT) AS df2, f.p_value AS f_p_value
            FROM pv p JOIN fv f ON p.model = f.model""",
         ["mclean"], ["estimate", "std_error", "t_value", "p_value", "r_squared", "adj_r_squared", "sigma", "f_stat",
                      "f_p_value"], SUMMARY_CTES)


def _fit_stats(s, d):
    _, f = _fit(s, d, "log_final")
    return reg.stats_table(s, f, "log_final").select(
        "n", "r_squared", "adj_r_squared", "sigma", "f_stat", "df1", "df2")


register(
    "mod_fit_stats", _fit_stats,
    """SELECT CAST(n AS BIGINT) AS n, 1 - rss / syy AS r_squared,
              1 - (rss / syy) * (n - 1) / (n - 4) AS adj_r_squared, sqrt(rss / (n - 4)) AS sigma,
              ((syy - rss) / 3) / (rss / (n - 4)) AS f_stat, CAST(3 AS BIGINT) AS df1,
              CAST(n - 4 AS BIGINT) AS df2 FROM log_final_fit""",
    ["mclean"], ["r_squared", "adj_r_squared", "sigma", "f_stat"], _ctes("log_final"))


def _anova(s, d):
    return reg.anova(s, *_fits(s, d, ("log_final", "log_interact")))


ANOVA_CTES = {**_plain_ctes("log_final"), **_plain_ctes("log_interact"),
              "ftest": """SELECT r.rss AS rss_reduced, f.rss AS rss_full, CAST(r.n - r.rank AS BIGINT) AS df_reduced,
                                 CAST(f.n - f.rank AS BIGINT) AS df_full,
                                 ((r.rss - f.rss) / (f.rank - r.rank)) / (f.rss / (f.n - f.rank)) AS f_stat,
                                 (f.n - f.rank) / 2.0 AS a, (f.rank - r.rank) / 2.0 AS b,
                                 (f.n - f.rank) / ((f.n - f.rank) + (r.rss - f.rss) / (f.rss / (f.n - f.rank))) AS x
                          FROM log_final_fit r, log_interact_fit f WHERE r.k = 1 AND f.k = 1""",
              **fsql.beta_ctes("fv", "ftest")}
register("mod_anova", _anova, "SELECT rss_reduced, rss_full, df_reduced, df_full, f_stat, p_value FROM fv",
         ["mclean"], ["rss_reduced", "rss_full", "f_stat", "p_value"], ANOVA_CTES)


def _pvalues(s, d):
    """p-values of the final model's terms, of its F test and of the nested-model test."""
    f, g = _fits(s, d, ("log_final", "log_interact"))
    coef = reg.coef_table(s, f, "log_final").select("term", "p_value")
    st = reg.stats_table(s, f, "log_final").select(F.lit("F").alias("term"), F.col("f_p_value").alias("p_value"))
    an = reg.anova(s, f, g).select(F.lit("anova").alias("term"), "p_value")
    return coef.unionByName(st).unionByName(an)


register("mod_pvalues", _pvalues, "SELECT term, p_value FROM pv", ["mclean"], ["p_value"],
         {**ANOVA_CTES, "fall": _ftest_sql(("log_final",)),
          "asked": f"SELECT term, a, b, x FROM ({_coef_sql(('log_final',))}) c UNION ALL "
                   "SELECT 'F', a, b, x FROM fall UNION ALL SELECT 'anova', a, b, x FROM ftest",
          **fsql.beta_ctes("pv", "asked")})


def _vif(s, d):
    _, f = _fit(s, d, "log_final")
    return reg.vif(s, f)


register(
    "mod_vif", _vif,
    "\nUNION ALL ".join(
        f"SELECT '{n}' AS term, (SELECT regr_sxx(_y, {n}) FROM log_final_d) / f.sxx_{n} AS vif"
        f" FROM log_final_fit f" for n, _ in SQL_TERMS["log_final"][1]),
    ["mclean"], ["vif"], _ctes("log_final"))


def _pred_sql(model, exp=False):
    y, terms = SQL_TERMS[model]
    e = "c.i + " + " + ".join(f"c.b_{n} * ({x})" for n, x in terms)
    return e if not exp else f"exp({e})"


def _coef_row(model):
    _, terms = SQL_TERMS[model]
    return {f"{model}_c": f"SELECT m.m_y - " + " - ".join(f"f.b_{n} * m.m_{n}" for n, _ in terms)
            + " AS i, " + ", ".join(f"f.b_{n}" for n, _ in terms)
            + f" FROM {model}_fit f, {model}_m m"}


def _predict(s, d):
    c, f = _fit(s, d, "log_final")
    spec = flows.MODELS["log_final"]
    p = reg.with_fit(c, flows.response(spec), spec.terms, f, keep=TRIP_KEY, log_response=True)
    return p.select(*TRIP_KEY, "fitted", "pred_dollars")


register("mod_predict", _predict,
         f"SELECT {KEY}, {_pred_sql('log_final')} AS fitted, "
         f"exp({_pred_sql('log_final')}) AS pred_dollars FROM mclean, log_final_c c",
         ["mclean"], ["fitted", "pred_dollars"], {**_ctes("log_final"), **_coef_row("log_final")})

register("mod_backtransform",
         lambda s, d: _predict(s, d).select(*TRIP_KEY, "pred_dollars"),
         f"SELECT {KEY}, exp({_pred_sql('log_final')}) AS pred_dollars FROM mclean, log_final_c c",
         ["mclean"], ["pred_dollars"], {**_ctes("log_final"), **_coef_row("log_final")})


def _metrics_sql(models):
    parts = []
    for m in models:
        log = SQL_TERMS[m][0].startswith("ln")
        pred = _pred_sql(m, exp=log)
        parts.append(f"""SELECT '{m}' AS model, sqrt(avg(pow(tip_amount - ({pred}), 2))) AS rmse,
       avg(abs(tip_amount - ({pred}))) AS mae FROM mclean, {m}_c c""")
    return "\nUNION ALL ".join(parts)


def _all_ctes(models):
    out = {}
    for m in models:
        out.update(_ctes(m))
        out.update(_coef_row(m))
    return out


ALL_MODELS = ("raw", "log_full", "log_final", "log_interact")


def _rmse(s, d):
    return flows.compare(clean(s, d), ("log_final",)).select("model", "rmse", "mae")


register("mod_rmse_mae", _rmse, _metrics_sql(["log_final"]), ["mclean"], ["rmse", "mae"],
         _all_ctes(["log_final"]))
register("mod_threshold",
         lambda s, d: flows.compare(clean(s, d), ALL_MODELS).select("model", "meets_target"),
         "SELECT model, rmse <= 2 AND mae <= 1.5 AS meets_target FROM ("
         + _metrics_sql(ALL_MODELS) + ") q", ["mclean"], (), _all_ctes(ALL_MODELS))
register("mod_compare", lambda s, d: flows.compare(clean(s, d), ALL_MODELS),
         "SELECT model, rmse, mae, rmse <= 2 AND mae <= 1.5 AS meets_target FROM ("
         + _metrics_sql(ALL_MODELS) + ") q", ["mclean"], ["rmse", "mae"], _all_ctes(ALL_MODELS))


def _flow_model_sql():
    parts = []
    for m in SUMMARISED:
        pred = _pred_sql(m, exp=SQL_TERMS[m][0].startswith("ln"))
        parts.append(f"""SELECT '{m}' AS model, count(*) AS n_predicted, sqrt(avg(pow(tip_amount - ({pred}), 2))) AS rmse,
       avg(abs(tip_amount - ({pred}))) AS mae, avg(tip_amount - ({pred})) AS mean_error,
       CAST(any_value(f.n) AS BIGINT) AS n_clean, CAST({len(SQL_TERMS[m][1]) + 1} AS BIGINT) AS rank,
       any_value(1 - f.rss / f.syy) AS r_squared, any_value(sqrt(f.rss / (f.n - {len(SQL_TERMS[m][1]) + 1}))) AS sigma
FROM mclean, {m}_c c, {m}_fit f""")
    return ("SELECT *, rmse <= 2 AND mae <= 1.5 AS meets_target FROM (" + "\nUNION ALL ".join(parts) + ") q")


register("flow_model", lambda s, d: flows.model(analysis(s, d), SUMMARISED), _flow_model_sql(), ["mclean"],
         ["rmse", "mae", "mean_error", "r_squared", "sigma"], _all_ctes(SUMMARISED))

# ---------------------------------------------------------------- diagnostics (on the full log model)


def _infl(s, d):
    c, f = _fit(s, d, "log_full")
    spec = flows.MODELS["log_full"]
    return dia.influence(c, flows.response(spec), spec.terms, f, keep=TRIP_KEY), f


INFL_CTES = {**_ctes("log_full"), **influence_ctes("log_full", SQL_TERMS["log_full"][1], TRIP_KEY)}
INFL = f"""SELECT i.*, d._y - i.resid AS fitted FROM log_full_infl i
           JOIN log_full_d d USING ({KEY})"""


def _dia(cols):
    def fn(s, d):
        infl, _ = _infl(s, d)
        return infl.select(*TRIP_KEY, *cols)
    return fn


for _id, _cols in (("dia_leverage", ["leverage"]), ("dia_rstudent", ["rstudent"]),
                   ("dia_cooks", ["cooks_d"]), ("dia_resid_fitted", ["fitted", "resid"]),
                   ("dia_resid_leverage", ["std_resid", "leverage"])):
    register(_id, _dia(_cols), f"SELECT {KEY}, {', '.join(_cols)} FROM ({INFL}) q", ["mclean"],
             _cols, INFL_CTES)

register("dia_scale_location",
         lambda s, d: _infl(s, d)[0].select(*TRIP_KEY, "fitted", "sqrt_abs_std_resid"),
         f"SELECT {KEY}, fitted, sqrt(abs(std_resid)) AS sqrt_abs_std_resid FROM ({INFL}) q",
         ["mclean"], ["fitted", "sqrt_abs_std_resid"], INFL_CTES)


def _flags(s, d):
    infl, f = _infl(s, d)
    return dia.flags(infl, f).select(*TRIP_KEY, "flag_rstudent", "flag_leverage", "flag_cooks")


register(
    "dia_flags", _flags,
    f"""SELECT {KEY}, abs(rstudent) > 3 AS flag_rstudent, leverage > 3.0 * 6 / n AS flag_leverage,
               cooks_d > 1 AS flag_cooks
        FROM ({INFL}) q, (SELECT n FROM log_full_fit) f
        WHERE abs(rstudent) > 3 OR leverage > 3.0 * 6 / n OR cooks_d > 1""",
    ["mclean"], (), INFL_CTES)


def _qq(s, d):
    infl, _ = _infl(s, d)
    return dia.qq(infl)


def _poly_sql(x, terms):
    out = f"{terms[-1]!r}::DOUBLE"
    for t in reversed(terms[:-1]):
        out = f"({out} * ({x}) + {t!r}::DOUBLE)"
    return out


def _quantile_sql(p):
    def ratio(x, q):
        return f"{_poly_sql(x, q[0])} / {_poly_sql(x, q[1])}"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    tail = f"CASE WHEN {r} <= 5 THEN {ratio(f'{r} - 1.6', dist.NORMAL_TAIL)} ELSE {ratio(f'{r} - 5', dist.NORMAL_FAR)} END"
    return (f"CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * "
            f"{ratio(f'0.180625 - ({p} - 0.5) * ({p} - 0.5)', dist.NORMAL_MIDDLE)} "
            f"WHEN {p} < 0.5 THEN -({tail}) ELSE {tail} END")


register("dia_qq", _qq,
         f"""SELECT i, p, sample, {_quantile_sql('p')} AS theoretical FROM (
  SELECT i, (i - CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END) / CAST(n + 1 - 2 * CASE WHEN n <= 10 THEN 0.375 ELSE 0.5 END AS DOUBLE) AS p,
         std_resid AS sample
  FROM (SELECT std_resid, row_number() OVER (ORDER BY std_resid) AS i, count(*) OVER () AS n FROM ({INFL}) q) r) t""",
         ["mclean"], ["p", "sample", "theoretical"], INFL_CTES)


def _topk_abs(s, d):
    infl, _ = _infl(s, d)
    return dia.top_by_measure(infl, TRIP_KEY, 10)


TOPK_SQL = "\nUNION ALL ".join(
    f"SELECT * FROM (SELECT '{m}' AS measure, {KEY}, {m} AS value FROM ({INFL}) q"
    f" ORDER BY abs({m}) DESC, {KEY} LIMIT 10) q_{m}" for m in ("cooks_d", "rstudent", "leverage"))
register("srt_topk_abs", _topk_abs, TOPK_SQL, ["mclean"], ["value"], INFL_CTES)

register("set_union_distinct",
         lambda s, d: dia.top_influential(_infl(s, d)[0], TRIP_KEY, 10),
         f"SELECT DISTINCT {KEY} FROM ({TOPK_SQL}) u", ["mclean"], (), INFL_CTES)


def _outliers(s, d):
    return flows.outliers(clean(s, d), TRIP_KEY, 10, "log_full")


register("flow_outliers", _outliers,
         f"SELECT * FROM mclean WHERE ({KEY}) IN (SELECT ({KEY}) FROM ({TOPK_SQL}) u)",
         ["mclean"], FEAT_DOUBLES, INFL_CTES)

# ---------------------------------------------------------------- cubic trend


def _cubic(s, d):
    f = trends.cubic(analysis(s, d), "fare_amount", "tip_amount")
    return reg.coef_table(s, f, "cubic").select("term", "estimate")


register("trend_cubic", _cubic, "SELECT * FROM cub_coef", ["feat"], ["estimate"],
         ols_ctes("cub", "feat", "tip_amount",
                  [("x1", "fare_amount"), ("x2", "fare_amount * fare_amount"),
                   ("x3", "fare_amount * fare_amount * fare_amount")]))

# ---------------------------------------------------------------- sample and feature flows
TARGET = flows.TARGET_N
SAMPLE_SQL = f"""
SELECT {KEY}, {', '.join(flows.SAMPLE_COLUMNS)}, file_month AS source_file, file_month AS month
FROM (SELECT *, row_number() OVER (PARTITION BY file_month
          ORDER BY md5(concat_ws('|', '123', {KEY})), {KEY}) AS rn FROM sel) q
WHERE rn <= (SELECT CAST(ceil({TARGET} / count(DISTINCT file_month)) AS BIGINT) FROM trips)"""


def _sample(s, d):
    return flows.sample(trips(s, d), zones(s, d), SELECTED, TARGET)


register("flow_sample", _sample, SAMPLE_SQL, ["sel", "trips"], TRIP_DOUBLES)
register("flow_features", lambda s, d: add_features(_sample(s, d)),
         "SELECT * FROM sfeat", ["sel", "trips"], FEAT_DOUBLES,
         {"samp": SAMPLE_SQL,
          "sfeat": oracle._FEATURES.format(src="(SELECT * EXCLUDE (month) FROM samp)")})

