"""Upper tails of test distributions, for small result tables (one row per column or pair)."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the helpers travel with the query, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EPS = 1e-16
_TINY = 1e-300
_MAX_TERMS = 100_000
# From here on the series would need more terms than that, and the normal forms agree to 1e-5 or better.
_LARGE_DOF = 1e6


def chi2_tail(x: float, dof: float) -> float:
    """P(X > x) for chi-square: the regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    if dof > _LARGE_DOF:  # the cube root of chi-square over its degrees of freedom is nearly normal
        spread = 2.0 / (9.0 * dof)
        return 0.5 * math.erfc((math.cbrt(x / dof) - 1.0 + spread) / math.sqrt(2.0 * spread))
    a, z = dof / 2.0, x / 2.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1.0 / a
        for k in range(1, _MAX_TERMS):
            term *= z / (a + k)
            total += term
            if term < total * _EPS:
                break
        return max(0.0, 1.0 - scale * total)
    # continued fraction, evaluated forwards with numerator/denominator ratios
    b = z + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    h = d
    for k in range(1, _MAX_TERMS):
        an = -k * (k - a)
        b += 2.0
        d = 1.0 / (an * d + b or _TINY)
        c = b + an / c or _TINY
        h *= d * c
        if abs(d * c - 1.0) < _EPS * 10:
            break
    return scale * h


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0) or _TINY)
    h = d
    for m in range(1, _MAX_TERMS):
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + step * d or _TINY)
            c = 1.0 + step / c or _TINY
            h *= d * c
        if abs(d * c - 1.0) < _EPS * 10:
            break
    return h


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| > |t|): the regularised incomplete beta function at dof / (dof + t^2)."""
    if math.isinf(t):
        return 0.0
    if dof > _LARGE_DOF:
        return math.erfc(abs(t) * (1.0 - 0.25 / dof) / math.sqrt(2.0 + t * t / dof))
    x = dof / (dof + t * t)
    if x >= 1.0:
        return 1.0
    a, b = dof / 2.0, 0.5
    log_front = (
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    front = math.exp(log_front)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def kolmogorov_tail(x: float) -> float:
    """Limiting P(sqrt(n) D > x)."""
    if x < 0.2:
        return 1.0  # the series alternates slowly here and the true value is 1 to 12 digits
    total = sum((-1) ** (k - 1) * math.exp(-2.0 * (k * x) ** 2) for k in range(1, 101))
    return min(1.0, max(0.0, 2.0 * total))


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def _defined(*xs) -> bool:
    return all(x is not None and not math.isnan(x) for x in xs)


@F.pandas_udf(T.DoubleType())
def _chi2(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(v, d) if _defined(v, d) and d > 0 else None for v, d in zip(x, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _t(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([t_two_sided(v, d) if _defined(v, d) and d > 0 else None for v, d in zip(t, dof)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _kolmogorov(x: pd.Series) -> pd.Series:
    return pd.Series([kolmogorov_tail(v) if _defined(v) else None for v in x], dtype="float64")


@F.pandas_udf(T.DoubleType())
def _normal(z: pd.Series) -> pd.Series:
    return pd.Series([normal_two_sided(v) if _defined(v) else None for v in z], dtype="float64")


def chi2_p(statistic: Column, dof: Column) -> Column:
    return _chi2(statistic.cast("double"), dof.cast("double"))


def t_p(statistic: Column, dof: Column) -> Column:
    return _t(statistic.cast("double"), dof.cast("double"))


def kolmogorov_p(statistic: Column) -> Column:
    return _kolmogorov(statistic.cast("double"))


def normal_p(statistic: Column) -> Column:
    return _normal(statistic.cast("double"))
