"""Statistical column functions.

Spark SQL has no ``erf`` or incomplete beta function.  The normal tail is
built from built-in expressions (a positive-term series for erf below 2.5, a
continued fraction for erfc above; both as ``aggregate`` over a fixed
sequence, so it stays in the JVM); it agrees with ``math.erfc`` to ~1e-15.
The Student-t tail of Pearson r (regularized incomplete beta) is an
Arrow-batched pandas UDF.  Both run on result-sized rows only (one row per
comparison or per rating group), never on prediction rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALPHA = 0.05


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the regularized incomplete beta (modified Lentz)."""
    tiny, eps = 1e-300, 1e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10000):
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
        delta = d * c
        h *= delta
        if abs(delta - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = (math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
           + a * math.log(x) + b * math.log1p(-x))
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


_MANY = 2000.0  # degrees of freedom from which the expansion below is exact to about 1e-12


def _many_rows_p(r: float, df: float) -> float:
    """Two-sided Student-t tail for many degrees of freedom, by Hill's normalising
    expansion: no difference of large logarithms, so it holds at any n."""
    a = df - 0.5
    b = 48.0 * a * a
    y = -a * math.log1p(-r * r)
    y = ((((-0.4 * y - 3.3) * y - 24.0) * y - 85.5) / (0.8 * y * y + 100.0 + b)
         + y + 3.0) / b * math.sqrt(y) + math.sqrt(y)
    return math.erfc(y / math.sqrt(2.0))


def _pearson_p(r: float, n: float) -> float:
    """Two-sided p of Pearson r under H0 (Student t with n-2 dof)."""
    if r is None or n is None or math.isnan(r) or n < 2:
        return float("nan")
    if n == 2:
        return 1.0  # two points always lie on a line
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2.0
    if df > _MANY:
        return _many_rows_p(r, df)
    t2 = r * r * df / (1.0 - r * r)
    return betainc_reg(df / 2.0, 0.5, df / (df + t2))


_TERMS = 80      # series / continued-fraction depth (converged to double precision)
_SWITCH = 2.5    # below: 1 - erf by series; above: erfc by continued fraction


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, from built-in expressions."""
    x2 = x * x
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(_TERMS)),
        F.struct(x.alias("t"), x.alias("s")),
        lambda acc, n: F.struct((acc["t"] * 2 * x2 / (2 * n + 1)).alias("t"),
                                (acc["s"] + acc["t"] * 2 * x2 / (2 * n + 1)).alias("s")),
        lambda acc: acc["s"])
    small = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-x2) * series
    frac = F.aggregate(F.sequence(F.lit(_TERMS), F.lit(1), F.lit(-1)), x,
                       lambda f, k: x + (k / 2.0) / f)
    large = F.exp(-x2) / (F.lit(math.sqrt(math.pi)) * frac)
    return F.when(x < _SWITCH, small).otherwise(large)


def normal_two_sided_p(z: Column) -> Column:
    """2 * P(Z > |z|) = erfc(|z| / sqrt 2) for a standard normal Z; null stays null."""
    return F.when(z.isNotNull(), erfc(F.abs(z) / F.lit(math.sqrt(2.0))))


@F.pandas_udf(T.DoubleType())
def pearson_p(r: pd.Series, n: pd.Series) -> pd.Series:
    out = np.array([_pearson_p(float(a), float(b)) if pd.notna(a) and pd.notna(b) else np.nan
                    for a, b in zip(r, n)], dtype=float)
    return pd.Series(out)


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def two_prop_ztest(x1: Column, n1: Column, x2: Column, n2: Column) -> dict[str, Column]:
    """Pooled two-proportion z-test, two-sided, as column expressions.

    The arithmetic follows the usual pooled-variance formula step for step, so
    z is bit-identical to the common statistics libraries.  z and p are null
    (and the result not significant) when the pooled share is 0 or 1."""
    p1 = F.try_divide(x1, n1)
    p2 = F.try_divide(x2, n2)
    pool = F.try_divide(x1 + x2, n1 + n2)
    nobs_fact = F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)
    defined = (pool > 0) & (pool < 1)
    z = F.when(defined, (p1 - p2) / F.sqrt(pool * (F.lit(1.0) - pool) * nobs_fact))
    p = normal_two_sided_p(z)
    return {"p1": p1, "p2": p2, "diff_pp": (p1 - p2) * 100, "z": z, "p_value": p,
            "significant": F.coalesce(p < ALPHA, F.lit(False))}
