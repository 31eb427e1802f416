"""Least squares in plain SQL for the oracle.

Each coefficient comes from a residualisation chain: every other predictor
is removed in turn with ``regr_slope``/``regr_intercept`` (Frisch-Waugh),
and the last slope is that predictor's coefficient. The chain in the
natural order also yields the orthogonalised predictors q_k, so leverage
is 1/n + sum q_k^2 / sum(q_k^2), and the final residual of y is the model
residual. This is independent of the Spark implementation (one moment
aggregate and a matrix solve).
"""

from __future__ import annotations

from typing import Sequence


def _chain(prefix: str, order: Sequence[str], base: str, keys: Sequence[str],
           carry_q: bool) -> tuple[dict[str, str], str]:
    ctes: dict[str, str] = {}
    cur = base
    kept_q: list[str] = []
    for j, v in enumerate(order[:-1]):
        rem = list(order[j + 1:]) + ["_y"]
        agg = f"{prefix}_a{j}"
        ctes[agg] = "SELECT " + ", ".join(
            f"regr_slope({c}, {v}) AS s_{c}, regr_intercept({c}, {v}) AS i_{c}" for c in rem
        ) + f" FROM {cur}"
        nxt = f"{prefix}_t{j}"
        qcols = "".join(f"t.{q}, " for q in kept_q)
        if carry_q:
            qcols += f"t.{v} AS q_{v}, "
            kept_q.append(f"q_{v}")
        ctes[nxt] = (f"SELECT {''.join(f't.{k}, ' for k in keys)}{qcols}"
                     + ", ".join(f"t.{c} - (a.i_{c} + a.s_{c} * t.{v}) AS {c}" for c in rem)
                     + f" FROM {cur} t, {agg} a")
        cur = nxt
    return ctes, cur


def ols_ctes(prefix: str, src: str, y: str, terms: Sequence[tuple[str, str]],
             keys: Sequence[str] = (), where: str = "TRUE") -> dict[str, str]:
    """CTEs ending in ``{prefix}_coef`` (term, estimate) and ``{prefix}_fit``
    (one row: n, rss, syy, b_<term>, sxx_<term> for each term)."""
    names = [n for n, _ in terms]
    notnull = " AND ".join([f"({y}) IS NOT NULL"] + [f"({e}) IS NOT NULL" for _, e in terms])
    ctes = {f"{prefix}_d": (f"SELECT {''.join(f'{k}, ' for k in keys)}CAST({y} AS DOUBLE) AS _y, "
                            + ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in terms)
                            + f" FROM {src} WHERE {notnull} AND {where}")}
    finals = []
    for k in names:
        order = [n for n in names if n != k] + [k]
        c, last = _chain(f"{prefix}_{k}", order, f"{prefix}_d", (), False)
        ctes.update(c)
        fin = f"{prefix}_{k}_f"
        ctes[fin] = (f"SELECT regr_slope(_y, {k}) AS b_{k}, regr_sxx(_y, {k}) AS sxx_{k}, "
                     f"regr_syy(_y, {k}) AS syy_{k}, regr_sxy(_y, {k}) AS sxy_{k} FROM {last}")
        finals.append((k, fin))
    k0, f0 = finals[0]
    ctes[f"{prefix}_fit"] = (
        "SELECT (SELECT count(*) FROM {d}) AS n, {f0}.syy_{k0} - {f0}.sxy_{k0} * {f0}.sxy_{k0} "
        "/ {f0}.sxx_{k0} AS rss, (SELECT regr_syy(_y, {k0}) FROM {d}) AS syy, ".format(
            d=f"{prefix}_d", f0=f0, k0=k0)
        + ", ".join(f"{fin}.b_{k} AS b_{k}, {fin}.sxx_{k} AS sxx_{k}" for k, fin in finals)
        + " FROM " + ", ".join(fin for _, fin in finals))
    means = ", ".join(f"avg({n}) AS m_{n}" for n in names)
    ctes[f"{prefix}_m"] = f"SELECT avg(_y) AS m_y, {means} FROM {prefix}_d"
    icpt = "m.m_y - " + " - ".join(f"f.b_{n} * m.m_{n}" for n in names)
    ctes[f"{prefix}_coef"] = (
        f"SELECT '(Intercept)' AS term, {icpt} AS estimate FROM {prefix}_fit f, {prefix}_m m"
        + "".join(f" UNION ALL SELECT '{n}', f.b_{n} FROM {prefix}_fit f" for n in names))
    return ctes


def influence_ctes(prefix: str, terms: Sequence[tuple[str, str]], keys: Sequence[str]
                   ) -> dict[str, str]:
    """CTE ``{prefix}_infl`` with keys, resid, leverage, std_resid, rstudent,
    cooks_d (needs ``ols_ctes`` with the same prefix and keys)."""
    names = [n for n, _ in terms]
    c, last = _chain(f"{prefix}_h", names, f"{prefix}_d", keys, True)
    ln = names[-1]
    qs = [f"q_{n}" for n in names[:-1]] + [ln]
    p1 = len(names) + 1
    ctes = dict(c)
    ctes[f"{prefix}_hr"] = (
        f"SELECT {''.join(f't.{k}, ' for k in keys)}"
        f"t._y - (regr_intercept(t._y, t.{ln}) OVER () + regr_slope(t._y, t.{ln}) OVER () * t.{ln})"
        " AS resid, 1.0 / count(*) OVER () + "
        + " + ".join(f"pow(t.{q} - avg(t.{q}) OVER (), 2)"
                     f" / (var_pop(t.{q}) OVER () * count(*) OVER ())" for q in qs)
        + f" AS leverage FROM {last} t")
    ctes[f"{prefix}_infl"] = (
        f"SELECT {''.join(f'h.{k}, ' for k in keys)}h.resid, h.leverage, "
        f"h.resid / sqrt(f.rss / (f.n - {p1}) * (1 - h.leverage)) AS std_resid, "
        f"h.resid / sqrt(((f.rss - h.resid * h.resid / (1 - h.leverage)) / (f.n - {p1} - 1))"
        f" * (1 - h.leverage)) AS rstudent, "
        f"h.resid * h.resid * h.leverage / ({p1} * f.rss / (f.n - {p1})"
        f" * (1 - h.leverage) * (1 - h.leverage)) AS cooks_d "
        f"FROM {prefix}_hr h, {prefix}_fit f")
    return ctes
