"""Performance metrics as column expressions over a returns column; use inside groupBy(...).agg(...).

Nulls are skipped; NaN and infinities must be nulled first (`finite`). Degenerate inputs give 0 unless stated.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

PPY = 252


def finite(x: Column | str) -> Column:
    """x, or null where it is NaN or infinite."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sharpe(r, ppy: float = PPY, risk_free: float = 0.0) -> Column:
    sd = F.stddev_samp(r)
    return F.when((F.count(r) >= 2) & (sd > 0), (F.avg(r) - F.lit(risk_free / ppy)) / sd * F.sqrt(F.lit(float(ppy)))).otherwise(0.0)


def volatility(r, ppy: float = PPY) -> Column:
    return F.when(F.count(r) >= 2, F.stddev_samp(r) * F.sqrt(F.lit(float(ppy)))).otherwise(0.0)


def cagr(r, ppy: float = PPY) -> Column:
    """Geometric annual growth; NaN once any return is -100 % or worse; 0 when empty."""
    r = _col(r)
    growth = F.exp(F.sum(F.log1p(F.when(r > -1, r))) * F.lit(float(ppy)) / F.count(r)) - 1
    return F.when(F.count(r) == 0, 0.0).when(F.min(r) <= -1, float("nan")).otherwise(growth)


def sortino(r, ppy: float = PPY, target: float = 0.0) -> Column:
    r, t = _col(r), F.lit(target / ppy)
    down = F.sqrt(F.avg(F.pow(F.least(r - t, F.lit(0.0)), 2)))
    return F.when((F.count(r) >= 2) & (down > 0), (F.avg(r) - t) / down * F.sqrt(F.lit(float(ppy)))).otherwise(0.0)


def win_rate(r) -> Column:
    r = _col(r)
    return F.coalesce(F.avg(F.when(r != 0, (r > 0).cast("double"))), F.lit(0.0))


def expected_value(r) -> Column:
    return F.coalesce(F.avg(r), F.lit(0.0))


def skewness(r) -> Column:
    return F.when((F.count(r) >= 3) & (F.var_pop(r) > 0), F.skewness(r)).otherwise(0.0)


def kurtosis(r) -> Column:
    return F.when((F.count(r) >= 4) & (F.var_pop(r) > 0), F.kurtosis(r)).otherwise(0.0)


def gaussian_var(r, alpha: float = 0.05) -> Column:
    return F.avg(r) + F.lit(NormalDist().inv_cdf(alpha)) * F.stddev_samp(r)


def value_at_risk(r, alpha: float = 0.05) -> Column:
    return F.percentile(r, F.lit(alpha))


def omega(r, threshold: float = 0.0) -> Column:
    r, t = _col(r), F.lit(threshold)
    return F.try_divide(F.sum(F.greatest(r - t, F.lit(0.0))), F.sum(F.greatest(t - r, F.lit(0.0))))


def gain_to_pain(r) -> Column:
    r = _col(r)
    return F.try_divide(F.sum(r), F.abs(F.sum(F.least(r, F.lit(0.0)))))


def tail_ratio(r, confidence: float = 0.95) -> Column:
    return F.try_divide(F.percentile(r, F.lit(confidence)), F.abs(F.percentile(r, F.lit(1 - confidence))))


def pezier_white(r, ppy: float = PPY) -> Column:
    """Sharpe adjusted for (biased) skewness and excess kurtosis."""
    sr = F.avg(r) / F.greatest(F.stddev_samp(r), F.lit(1e-12))
    return sr * (1 + skewness(r) / 6 * sr - kurtosis(r) / 24 * sr * sr) * F.sqrt(F.lit(float(ppy)))
