"""Distribution functions that Spark SQL lacks: the normal and chi-square ones as column expressions, Student's t on Arrow batches."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EULER = 0.5772156649015329
_erfc = np.frompyfunc(math.erfc, 1, 1)
_inv = np.frompyfunc(lambda p: NormalDist().inv_cdf(p) if 0 < p < 1 else (math.nan if p != p else math.copysign(math.inf, p - 0.5)), 1, 1)


def phi(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.asarray(_erfc(-np.asarray(x, float) / math.sqrt(2)), float)


def phi_inv(p: np.ndarray) -> np.ndarray:
    return np.asarray(_inv(np.asarray(p, float)), float)


#: West's (2005) rational form of the normal distribution, highest power first.
_CDF_TOP = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376]
_CDF_BOTTOM = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
#: Wichura's algorithm AS 241 for the normal quantile, lowest power first: (top, bottom) by region.
_PPF = [
    ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3],
     [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]),
    ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4],
     [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]),
    ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7],
     [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]),
]


def _poly(down: list[float], x):
    out = down[0]
    for k in down[1:]:
        out = out * x + k
    return out


def _of(x, f) -> Column:
    """f of x; f names its argument many times, as a lambda's argument it is computed once."""
    return F.element_at(F.transform(F.array((F.col(x) if isinstance(x, str) else x).cast("double")), f), 1)


def _cdf(x: Column) -> Column:
    a = F.abs(x)
    bell = F.exp(-a * a / 2)
    near, far = bell * _poly(_CDF_TOP, a) / _poly(_CDF_BOTTOM, a), bell / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + 0.65))))) / 2.506628274631
    tail = F.when(a < 7.07106781186547, near).when(a < 37, far).otherwise(0.0)
    return F.when(x > 0, 1 - tail).when(x <= 0, tail)


def _ppf(p: Column) -> Column:
    q = p - 0.5
    part = lambda k, x: _poly(_PPF[k][0][::-1], x) / _poly(_PPF[k][1][::-1], x)
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    far = F.when(r <= 5, part(1, r - 1.6)).otherwise(part(2, r - 5))
    edge = F.when(p == 0, float("-inf")).when(p == 1, float("inf"))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, q * part(0, 0.180625 - q * q)).otherwise(F.signum(q) * far)).otherwise(edge)


def norm_cdf(x) -> Column:
    return _of(x, _cdf)


def norm_ppf(p) -> Column:
    return _of(p, _ppf)


def two_sided(z) -> Column:
    """Two-sided normal p-value of a statistic."""
    return _of(z, lambda x: 2 * _cdf(-F.abs(x)))


def chi2_sf_of(x, k: int) -> Column:
    """P(chi-square of k degrees > x), by the recurrence in k from one or two degrees."""

    def f(x):
        out = 2 * _cdf(-F.sqrt(x)) if k % 2 else F.exp(-x / 2)
        for j in range(k % 2 or 2, k, 2):
            out += F.pow(x / 2, F.lit(j / 2)) * F.exp(-x / 2) / math.gamma(j / 2 + 1)
        return F.when(x <= 0, 1.0).otherwise(out)

    return _of(x, f)


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series or continued fraction."""
    if x <= 0:
        return 0.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * lead
    b, c, d = x + 1 - a, 1e300, 1 / (x + 1 - a)
    h = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or 1e-300)
        c = (b + an / c) or 1e-300
        h *= (step := c * d)
        if abs(step - 1) < 1e-15:
            break
    return 1 - lead * h


def chi2_sf(x: float, k: float) -> float:
    return 1 - gamma_p(k / 2, x / 2) if x > 0 else 1.0


def beta_i(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_i(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or 1e-300)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            h *= (step := c * d)
        if abs(step - 1) < 1e-15:
            break
    return lead * h


def student_t_sf(t: float, df: float) -> float:
    """P(T > t)."""
    tail = 0.5 * beta_i(df / 2, 0.5, df / (df + t * t))
    return tail if t > 0 else 1 - tail


@F.pandas_udf(T.DoubleType())
def student_t_sf_udf(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([student_t_sf(a, b) for a, b in zip(t, df)], dtype=float)
