"""Factor models in plain SQL for the oracle: a sparse design, its
cross-products by a join, and a sweep over the matrix held as one list.

It shares nothing with the Spark side: raw sums instead of centred ones, and
one recursive query instead of a matrix library. Tail probabilities come from
the continued fraction of the incomplete beta function, folded over a list.
"""

from __future__ import annotations

from typing import Sequence

STEPS = 600
ALIASED = 1e-10


def design_ctes(prefix: str, src: str, y: str, predictors: Sequence[str], factors: dict[str, str]) -> dict[str, str]:
    """``{prefix}_terms`` (k, term, block) and ``{prefix}_g``: one row with n, p and
    the cross-products of (intercept, terms, response) as a list by rows.
    ``factors``: name to the SQL that orders its levels (``lev``)."""
    whole = " AND ".join(f"{c} IS NOT NULL" for c in [f"({y})", *predictors])
    ctes = {f"{prefix}_r": f"SELECT row_number() OVER () AS rid, CAST({y} AS DOUBLE) AS _y, {', '.join(predictors)} FROM {src} WHERE {whole}"}
    parts, cells = ["SELECT 0 AS block, 1 AS r, '(Intercept)' AS term"], [f"SELECT rid, 0 AS block, 1 AS r, CAST(1 AS DOUBLE) AS v FROM {prefix}_r"]
    for b, c in enumerate(predictors, 1):
        if c not in factors:
            parts.append(f"SELECT {b}, 1, '{c}'")
            cells.append(f"SELECT rid, {b}, 1, CAST({c} AS DOUBLE) FROM {prefix}_r")
            continue
        lv = f"{prefix}_l{b}"
        ctes[lv] = (f"SELECT lev, row_number() OVER (ORDER BY {factors[c]}, lev) AS r "
                    f"FROM (SELECT DISTINCT CAST({c} AS VARCHAR) AS lev FROM {src} WHERE {c} IS NOT NULL) q")
        parts.append(f"SELECT {b}, r, '{c}_' || lev FROM {lv} WHERE r > 1")
        cells.append(f"SELECT rid, {b}, r, CAST(1 AS DOUBLE) FROM {prefix}_r JOIN {lv} ON CAST({c} AS VARCHAR) = lev WHERE r > 1")
    ctes[f"{prefix}_terms"] = f"SELECT *, row_number() OVER (ORDER BY block, r) AS k FROM ({' UNION ALL '.join(parts)}) q"
    ctes[f"{prefix}_cells"] = (
        f"SELECT rid, list({{'k': k, 'v': v}}) AS cs FROM (SELECT rid, k, v FROM ({' UNION ALL '.join(cells)}) c "
        f"JOIN {prefix}_terms t ON c.block = t.block AND c.r = t.r UNION ALL "
        f"SELECT rid, (SELECT count(*) + 1 FROM {prefix}_terms), _y FROM {prefix}_r) q GROUP BY rid")
    ctes[f"{prefix}_xx"] = (
        "SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS s FROM (SELECT rid, unnest(cs) AS a, cs FROM "
        f"{prefix}_cells) q, unnest(q.cs) AS u(b) GROUP BY 1, 2")
    ctes[f"{prefix}_g"] = (
        f"SELECT p, (SELECT count(*) FROM {prefix}_r) AS n, (SELECT list(coalesce(s, 0.0) ORDER BY i, j) FROM "
        f"(SELECT a.i, b.j, s FROM range(1, p + 2) a(i) CROSS JOIN range(1, p + 2) b(j) LEFT JOIN {prefix}_xx x "
        f"ON x.i = a.i AND x.j = b.j) q) AS g FROM (SELECT count(*) AS p FROM {prefix}_terms) t")
    return ctes


def _swept(w: str, k: str) -> str:
    """The matrix ``g`` (width ``w``) swept on its ``k``-th pivot."""
    d = f"g[({k} - 1) * {w} + {k}]"
    return (f"list_transform(range(0, len(g)), lambda x: CASE "
            f"WHEN x // {w} = {k} - 1 AND x % {w} = {k} - 1 THEN -1 / {d} "
            f"WHEN x // {w} = {k} - 1 THEN g[x + 1] / {d} WHEN x % {w} = {k} - 1 THEN g[x + 1] / {d} "
            f"ELSE g[x + 1] - g[(x // {w}) * {w} + {k}] * g[({k} - 1) * {w} + x % {w} + 1] / {d} END)")


def sweep_ctes(prefix: str) -> dict[str, str]:
    """``{prefix}_fit`` (term, k, estimate, v: its unscaled variance, rss, n, rank)."""
    w = "(p + 1)"
    d = f"g[k * {w} + k + 1]"
    first = f"first[k * {w} + k + 1]"
    live = f"({d} > {ALIASED} * greatest(coalesce(after[k * {w} + k + 1], {d}), 1e-3 * {first}))"
    ctes = {f"{prefix}_s(k, p, n, g, first, after, live)": (
        f"SELECT 0, p, n, g, g, CAST(NULL AS DOUBLE[]), CAST([] AS BIGINT[]) FROM {prefix}_g UNION ALL "
        f"SELECT k + 1, p, n, CASE WHEN {live} THEN {_swept(w, '(k + 1)')} ELSE g END, first, "
        f"CASE WHEN k = 0 THEN {_swept(w, '1')} ELSE after END, CASE WHEN {live} THEN list_append(live, k + 1) ELSE live END "
        f"FROM {prefix}_s WHERE k < p")}
    ctes[f"{prefix}_fit"] = (
        f"SELECT t.term, t.block, t.k, n, len(live) AS rank, g[p * {w} + p + 1] AS rss, after[p * {w} + p + 1] AS syy, "
        f"CASE WHEN list_contains(live, t.k) THEN g[(t.k - 1) * {w} + p + 1] END AS estimate, "
        f"CASE WHEN list_contains(live, t.k) THEN -g[(t.k - 1) * {w} + t.k] END AS v "
        f"FROM (SELECT * FROM {prefix}_s WHERE k = p) s, {prefix}_terms t")
    return ctes


def beta_ctes(name: str, src: str) -> dict[str, str]:
    """``{name}``: the rows of ``src`` with ``p_value``, the regularised incomplete
    beta function at (a, b, x)."""
    turned = f"""SELECT *, x >= (a + 1) / (a + b + 2) AS turn, CASE WHEN x >= (a + 1) / (a + b + 2) THEN b ELSE a END AS a1,
  CASE WHEN x >= (a + 1) / (a + b + 2) THEN a ELSE b END AS b1,
  CASE WHEN x >= (a + 1) / (a + b + 2) THEN 1 - x ELSE x END AS x1 FROM {src}"""
    even = "(e.m * (b1 - e.m) * x1 / ((a1 - 1 + 2 * e.m) * (a1 + 2 * e.m)))"
    odd = "(-(a1 + e.m) * (a1 + b1 + e.m) * x1 / ((a1 + 2 * e.m) * (a1 + 1 + 2 * e.m)))"
    d1, c1 = f"(1 / (1 + {even} * s.d))", f"(1 + {even} / s.c)"
    d2, c2 = f"(1 / (1 + {odd} * {d1}))", f"(1 + {odd} / {c1})"
    start = "1 / (1 - (a1 + b1) * x1 / (a1 + 1))"
    folded = (f"list_reduce(list_transform(range(1, {STEPS}), lambda m: {{'m': CAST(m AS DOUBLE), 'c': 1.0::DOUBLE, "
              f"'d': 0.0::DOUBLE, 'h': 0.0::DOUBLE}}), lambda s, e: {{'m': e.m, 'c': {c2}, 'd': {d2}, "
              f"'h': s.h * {d1} * {c1} * {d2} * {c2}}}, {{'m': 0.0::DOUBLE, 'c': 1.0::DOUBLE, 'd': {start}, 'h': {start}}})")
    value = f"exp(lgamma(a1 + b1) - lgamma(a1) - lgamma(b1) + a1 * ln(x1) + b1 * ln(1 - x1)) * ({folded}).h / a1"
    return {f"{name}_t": turned,
            name: f"SELECT * EXCLUDE (turn, a1, b1, x1), CASE WHEN x IS NULL THEN NULL WHEN x >= 1 THEN 1.0 WHEN x <= 0 THEN 0.0 "
                  f"WHEN turn THEN 1 - {value} ELSE {value} END AS p_value FROM {name}_t"}


def determinant_ctes(prefix: str) -> dict[str, str]:
    """``{prefix}_gv`` (term, gvif, df, gvif_scaled) of each block of live terms:
    logarithms of the determinants of a block, of the rest and of all, as sums
    of the pivots of the swept correlation-scaled matrix."""
    w = "(p + 1)"
    d = f"g[k * {w} + k + 1]"
    return {
        f"{prefix}_live": f"SELECT k, block FROM {prefix}_fit WHERE estimate IS NOT NULL AND k > 1",
        f"{prefix}_sets": (
            f"SELECT 0 AS block, 'all' AS part, list(k ORDER BY k) AS ks FROM {prefix}_live UNION ALL "
            f"SELECT b.block, CASE WHEN l.block = b.block THEN 'own' ELSE 'rest' END, list(l.k ORDER BY l.k) "
            f"FROM (SELECT DISTINCT block FROM {prefix}_live) b, {prefix}_live l GROUP BY 1, 2"),
        f"{prefix}_d(block, part, ks, k, p, g, first, logdet)": (
            f"SELECT block, part, list_prepend(1, ks), 0, p, g, CAST(NULL AS DOUBLE[]), CAST(0 AS DOUBLE) FROM {prefix}_sets, {prefix}_g UNION ALL "
            f"SELECT block, part, ks, k + 1, p, CASE WHEN list_contains(ks, k + 1) THEN {_swept(w, '(k + 1)')} ELSE g END, "
            f"CASE WHEN k = 0 THEN {_swept(w, '1')} ELSE first END, "
            f"logdet + CASE WHEN k > 0 AND list_contains(ks, k + 1) THEN ln({d} / first[k * {w} + k + 1]) ELSE 0.0 END "
            f"FROM {prefix}_d WHERE k < p"),
        f"{prefix}_dets": f"SELECT block, part, logdet, len(ks) - 1 AS size FROM {prefix}_d WHERE k = p",
        f"{prefix}_gv": (
            f"SELECT o.block, exp(o.logdet + coalesce(r.logdet, 0) - a.logdet) AS gvif, CAST(o.size AS BIGINT) AS df, "
            f"exp((o.logdet + coalesce(r.logdet, 0) - a.logdet) / (2 * o.size)) AS gvif_scaled "
            f"FROM {prefix}_dets o LEFT JOIN {prefix}_dets r ON o.block = r.block AND r.part = 'rest', "
            f"(SELECT logdet FROM {prefix}_dets WHERE part = 'all') a WHERE o.part = 'own'")}
