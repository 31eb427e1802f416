"""Distribution functions: scalars for model summaries (driver side, on a
handful of numbers per model; scipy is not available) and the normal quantile
as a column expression, for a value in every row.

The regularised incomplete beta function uses the standard continued
fraction (modified Lentz); t and F tail probabilities follow from it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _betacf(a: float, b: float, x: float, max_iter: int = 500, eps: float = 3e-16) -> float:
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, max_iter + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1 - x) / b


def t_two_sided_p(t: float, df: float) -> float:
    """P(|T| > |t|) for Student's t with ``df`` degrees of freedom."""
    if t is None or math.isnan(t) or df <= 0:
        return float("nan")
    if math.isinf(t):
        return 0.0
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_upper_p(f: float, d1: float, d2: float) -> float:
    """P(F > f) for the F distribution with (d1, d2) degrees of freedom."""
    if f is None or math.isnan(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


# The rational approximations of the normal quantile published as
# algorithm AS 241 (Wichura 1988), numerator and denominator from the constant
# up: the middle, the tails, the far tails
NORMAL_MIDDLE = ((3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125,
                  45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
                 (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867,
                  39307.895800092710610, 28729.085735721942674, 5226.4952788528545610))
NORMAL_TAIL = ((1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504,
                1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
               (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
                0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9))
NORMAL_FAR = ((6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230,
               0.0265321895265761230930, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
              (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4,
               1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15))


def _ratio(x: Column, polynomials) -> Column:
    def value(terms):
        out = F.lit(terms[-1])
        for t in reversed(terms[:-1]):
            out = out * x + F.lit(t)
        return out
    return value(polynomials[0]) / value(polynomials[1])


def normal_quantile(p: Column) -> Column:
    """Normal quantile of a probability column, to about 16 digits; NULL outside
    (0, 1)."""
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(r - 1.6, NORMAL_TAIL)).otherwise(_ratio(r - 5, NORMAL_FAR))
    z = F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, NORMAL_MIDDLE)).otherwise(F.when(q < 0, -tail).otherwise(tail))
    return F.when((p > 0) & (p < 1), z)
