"""Least squares through one moment aggregate.

A fit is ONE distributed pass: n, means and the centred cross-products of the
response and the p predictors (``moments.listwise``, whatever p is). Only that
p x p summary reaches the driver, where it is solved by a sweep that finds the
rank: predictors that earlier ones determine are aliased and get no coefficient.
Everything per-row afterwards (fitted values, residuals, leverage, influence) is
a column expression with the solved numbers as literals, so it runs inside
whole-stage codegen.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass
from typing import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipscope.functions.distributions import f_upper_p, t_two_sided_p
from tipscope.operators.moments import Indicator, Moments, listwise

Terms = Sequence[tuple[str, Column]]


def term(name: str, expr: Column | str | None = None) -> tuple[str, Column]:
    if expr is None:
        return name, F.col(name)
    return name, F.col(expr) if isinstance(expr, str) else expr


def design(df: DataFrame, y: Column, terms: Terms, keep: Sequence[str] = ()) -> DataFrame:
    """Model frame: response ``_y`` and one column per term, rows with any
    NULL dropped (R's na.omit)."""
    names = [n for n, _ in terms]
    d = df.select(*[F.col(k) for k in keep], y.cast("double").alias("_y"),
                  *[e.cast("double").alias(n) for n, e in terms])
    return d.dropna(subset=["_y", *names])


@dataclass
class OlsFit:
    terms: list[str]
    n: int
    xbar: np.ndarray
    ybar: float
    sxx: np.ndarray          # centred cross-products of predictors (p x p)
    sxy: np.ndarray
    syy: float
    beta: np.ndarray         # slopes, NaN for aliased terms
    intercept: float
    sxx_inv: np.ndarray      # zero for aliased terms
    rss: float
    live: list[int]          # terms that are not aliased

    @property
    def p(self) -> int:
        """Terms that count: the rank without the intercept."""
        return len(self.live)

    @property
    def n_params(self) -> int:
        return self.p + 1

    @property
    def df_resid(self) -> int:
        return self.n - self.n_params

    @property
    def sigma2(self) -> float:
        return self.rss / self.df_resid if self.df_resid > 0 else float("nan")

    def coefficients(self) -> list[tuple]:
        """(term, estimate, standard error, t, p); None for aliased terms and for
        what has no value (no residual degrees of freedom, no spread)."""
        s2 = self.sigma2
        var = [1.0 / self.n + float(self.xbar @ self.sxx_inv @ self.xbar) if self.n else float("nan"), *np.diag(self.sxx_inv)]
        rows = []
        for i, (nm, b, v) in enumerate(zip(["(Intercept)", *self.terms], [self.intercept, *self.beta.tolist()], var)):
            if i and i - 1 not in self.live:
                rows.append((nm, None, None, None, None))
                continue
            se = math.sqrt(max(v * s2, 0.0)) if not math.isnan(v * s2) else float("nan")
            t = b / se if se > 0 else float("nan")
            rows.append((nm, *[None if math.isnan(x) else float(x) for x in (b, se, t, t_two_sided_p(t, self.df_resid))]))
        return rows

    def stats(self) -> dict:
        r2 = 1 - self.rss / self.syy if self.syy > 0 else float("nan")
        adj = 1 - (1 - r2) * (self.n - 1) / self.df_resid if self.df_resid > 0 else float("nan")
        f = ((self.syy - self.rss) / self.p) / self.sigma2 if self.p > 0 and self.sigma2 > 0 else float("nan")
        return {"n": self.n, "n_params": self.n_params, "rss": self.rss,
                "r_squared": r2, "adj_r_squared": adj, "sigma": math.sqrt(self.sigma2),
                "f_stat": f, "df1": self.p, "df2": self.df_resid,
                "f_p_value": f_upper_p(f, self.p, self.df_resid)}

    # ---- row expressions
    def predict(self, values: dict[str, Column] | None = None) -> Column:
        """Fitted value as a column expression over the term columns, or over
        ``values`` by term (mod_predict); NULL where any term is."""
        values = values or {t: F.col(t) for t in self.terms}
        e = F.lit(float(self.intercept))
        for i in self.live:
            e = e + F.lit(float(self.beta[i])) * values[self.terms[i]]
        gone = [values[t].isNull() for i, t in enumerate(self.terms) if i not in self.live]
        return F.when(~functools.reduce(lambda a, b: a | b, gone), e) if gone else e

    def leverage(self) -> Column:
        """Hat value 1/n + (x - xbar)' Sxx^-1 (x - xbar) (dia_leverage)."""
        c = [F.col(nm) - F.lit(float(m)) for nm, m in zip(self.terms, self.xbar)]
        e = F.lit(1.0 / self.n)
        for i in self.live:
            for j in self.live:
                e = e + F.lit(float(self.sxx_inv[i, j])) * c[i] * c[j]
        return e


# A term is aliased when what the earlier terms leave of it is below ALIASED of
# its sum of squares, or when its spread is below FLAT of its size
ALIASED, FLAT = 1e-10, 1e-13


def live_terms(sxx: np.ndarray, xbar: np.ndarray, n: int) -> list[int]:
    """Terms that the earlier ones don't determine, by a sweep over the centred
    cross-products in the terms' order: each pivot is the part of a term that the
    terms kept before it leave over. A constant term has none."""
    ss = np.diag(sxx)
    scale = np.sqrt(np.where(ss > 0, ss, 1.0))
    left = sxx / np.outer(scale, scale)
    kept = []
    for k in range(len(ss)):
        if ss[k] <= FLAT * FLAT * n * xbar[k] ** 2 or left[k, k] <= ALIASED:
            continue
        kept.append(k)
        left = left - np.outer(left[:, k], left[k]) / left[k, k]
    return kept


def solve(m: Moments, terms: Sequence[str]) -> OlsFit:
    """The fit from the moments of (response, terms): aliased terms have no
    coefficient (NaN) and cost no degree of freedom."""
    p = len(terms)
    xbar, ybar = m.mean[1:], float(m.mean[0]) if m.n else float("nan")
    sxx, sxy, syy = m.sxx[1:, 1:], m.sxx[1:, 0], float(m.sxx[0, 0])
    live = live_terms(sxx, xbar, m.n)
    sxx_inv, beta = np.zeros((p, p)), np.full(p, np.nan)
    used = np.zeros(p)
    if live:
        at = np.ix_(live, live)
        scale = np.sqrt(np.diag(sxx)[live])  # solved at unit diagonal, for conditioning
        sxx_inv[at] = np.linalg.inv(sxx[at] / np.outer(scale, scale)) / np.outer(scale, scale)
        used = sxx_inv @ sxy
        beta[live] = used[live]
    rss = max(syy - float(used @ sxy), 0.0)
    return OlsFit(list(terms), m.n, xbar, ybar, sxx, sxy, syy, beta, ybar - float(used @ xbar), sxx_inv, rss, live)


def fit_many(df: DataFrame, models: Sequence[tuple[Column, Terms]]) -> list[OlsFit]:
    """Fits of several models over the same rows from ONE pass: each model's
    complete rows are taken apart, terms of the same name are the same column."""
    columns, groups = {}, []
    for i, (y, terms) in enumerate(models):
        columns[f"_y{i}"] = y
        columns.update({t[0]: t if isinstance(t, Indicator) else t[1] for t in terms})
        groups.append([f"_y{i}", *[n for n, _ in terms]])
    return [solve(m, [n for n, _ in terms]) for m, (_, terms) in zip(listwise(df, columns, groups), models)]


def fit(df: DataFrame, y: Column, terms: Terms) -> OlsFit:
    """Ordinary least squares with intercept (mod_ols_*)."""
    return fit_many(df, [(y, terms)])[0]


def coef_table(spark: SparkSession, f: OlsFit, model: str = "model") -> DataFrame:
    """Estimates, standard errors, t and p per term (mod_summary)."""
    schema = T.StructType([T.StructField("model", T.StringType()),
                           T.StructField("term", T.StringType()),
                           T.StructField("estimate", T.DoubleType()),
                           T.StructField("std_error", T.DoubleType()),
                           T.StructField("t_value", T.DoubleType()),
                           T.StructField("p_value", T.DoubleType())])
    return spark.createDataFrame([(model, *r) for r in f.coefficients()], schema)


def stats_table(spark: SparkSession, f: OlsFit, model: str = "model") -> DataFrame:
    """R², adjusted R², residual s, F with its p-value (mod_summary)."""
    s = f.stats()
    schema = T.StructType([T.StructField("model", T.StringType())] + [
        T.StructField(k, T.LongType() if k in ("n", "n_params", "df1", "df2") else T.DoubleType())
        for k in s])
    return spark.createDataFrame([(model, *[s[k] for k in s])], schema)


def anova(spark: SparkSession, reduced: OlsFit, full: OlsFit) -> DataFrame:
    """Nested-model F test (mod_anova)."""
    ddf = reduced.df_resid - full.df_resid
    fst = p = None  # the models have the same rank, or the full one has no residual
    if ddf > 0 and full.df_resid > 0 and full.rss > 0:
        fst = ((reduced.rss - full.rss) / ddf) / (full.rss / full.df_resid)
        p = f_upper_p(fst, ddf, full.df_resid)
    schema = T.StructType([T.StructField(k, t) for k, t in (
        ("rss_reduced", T.DoubleType()), ("rss_full", T.DoubleType()),
        ("df_reduced", T.LongType()), ("df_full", T.LongType()),
        ("f_stat", T.DoubleType()), ("p_value", T.DoubleType()))])
    return spark.createDataFrame([(reduced.rss, full.rss, reduced.df_resid, full.df_resid,
                                   fst, p)], schema)


def vif(spark: SparkSession, f: OlsFit) -> DataFrame:
    """Variance inflation: diagonal of the inverse predictor correlation
    matrix (mod_vif); >= 1 by construction, NULL for aliased terms."""
    schema = T.StructType([T.StructField("term", T.StringType()),
                           T.StructField("vif", T.DoubleType())])
    return spark.createDataFrame([(t, float(f.sxx_inv[i, i] * f.sxx[i, i]) if i in f.live else None)
                                  for i, t in enumerate(f.terms)], schema)


def with_fit(df: DataFrame, y: Column, terms: Terms, f: OlsFit, keep: Sequence[str] = (),
             log_response: bool = False) -> DataFrame:
    """Model frame plus fitted value and residual; with ``log_response`` the
    dollar-scale prediction exp(fitted) too (mod_predict, mod_backtransform)."""
    d = design(df, y, terms, keep).withColumn("fitted", f.predict())
    d = d.withColumn("resid", F.col("_y") - F.col("fitted"))
    if log_response:
        d = d.withColumn("pred_dollars", F.exp("fitted"))
    return d


def signif(c: Column, digits: int = 9) -> Column:
    """Round to significant digits (for comparing large sums across engines)."""
    k = F.floor(F.log10(F.abs(c))) - (digits - 1)
    return F.when(c == 0, F.lit(0.0)).otherwise(F.round(c / F.pow(F.lit(10.0), k)) * F.pow(F.lit(10.0), k))


def gram_long(df: DataFrame, y: Column, terms: Terms) -> DataFrame:
    """X'X, X'y, y'y and n in long form (row_term, col_term, value), as raw
    sums with the intercept column named '1' (mod_gram)."""
    names = [n for n, _ in terms]
    d = design(df, y, terms)
    cols = [("1", F.lit(1.0)), *[(n, F.col(n)) for n in names], ("y", F.col("_y"))]
    aggs = []
    for i, (a, ca) in enumerate(cols):
        for b, cb in cols[i:]:
            aggs.append(F.sum(ca * cb).alias(f"{a}__{b}"))
    wide = d.agg(*aggs)
    lg = wide.unpivot([], [f"{a}__{b}" for i, (a, _) in enumerate(cols) for b, _ in cols[i:]],
                      "key", "value")
    return lg.select(F.regexp_extract("key", r"^(.*)__", 1).alias("row_term"),
                     F.substring_index("key", "__", -1).alias("col_term"), "value")


def gvif(spark: SparkSession, f: OlsFit, blocks: dict[str, Sequence[str]]) -> DataFrame:
    """Generalised variance inflation for term blocks (a factor's dummy
    columns form one block): GVIF = det(R11) det(R22) / det(R), with R the
    predictor correlation matrix, R11 the block and R22 the other terms;
    also GVIF^(1/(2 df)) (mod_vif for factors). Aliased terms are left out, and
    so is a block of which nothing is left."""
    d = np.sqrt(np.diag(f.sxx))
    live = f.live
    R = f.sxx[np.ix_(live, live)] / np.outer(d[live], d[live])
    names = [f.terms[i] for i in live]
    det_all = np.linalg.det(R)
    rows = []
    for blk, terms in blocks.items():
        idx = [names.index(t) for t in terms if t in names]
        rest = [i for i in range(len(names)) if i not in idx]
        if not idx:
            continue
        r11 = np.linalg.det(R[np.ix_(idx, idx)])
        r22 = np.linalg.det(R[np.ix_(rest, rest)]) if rest else 1.0
        g = float(r11 * r22 / det_all)
        rows.append((blk, g, len(idx), float(g ** (1.0 / (2 * len(idx))))))
    schema = T.StructType([T.StructField("term", T.StringType()),
                           T.StructField("gvif", T.DoubleType()),
                           T.StructField("df", T.LongType()),
                           T.StructField("gvif_scaled", T.DoubleType())])
    return spark.createDataFrame(rows, schema)
