"""Risk measures that need a quantile or a window first."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m

from .simulate import drawdown_episodes, equity


def _with_quantiles(df: DataFrame, key: str, value: str, **q: float) -> DataFrame:
    """df with its group's quantiles; one row per group, so Spark decides on a broadcast by its size."""
    return df.join(df.groupBy(key).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in q.items()]), key)


def var_cvar(returns: DataFrame, key: str = "run_id", r: str = "r") -> DataFrame:
    d = _with_quantiles(returns, key, r, q=0.05, q1=0.01)
    return d.groupBy(key).agg(F.max("q").alias("var95"), F.avg(F.when(F.col(r) <= F.col("q"), F.col(r))).alias("cvar95"), F.max("q1").alias("var99"))


def rachev(returns: DataFrame, key: str = "run_id", alpha: float = 0.05) -> DataFrame:
    d = _with_quantiles(returns, key, "r", hi=1 - alpha, lo=alpha)
    return d.groupBy(key).agg(F.try_divide(F.avg(F.when(F.col("r") >= F.col("hi"), F.col("r"))), F.abs(F.avg(F.when(F.col("r") <= F.col("lo"), F.col("r"))))).alias("rachev"))


def cdar(returns: DataFrame, key: str = "run_id", confidence: float = 0.95) -> DataFrame:
    d = equity(returns, key).select(key, (-F.col("drawdown")).alias("depth"))
    d = _with_quantiles(d, key, "depth", q=confidence)
    return d.groupBy(key).agg(F.avg(F.when(F.col("depth") >= F.col("q"), F.col("depth"))).alias("cdar"))


def sterling_burke(returns: DataFrame, key: str = "run_id", deepest: int = 5) -> DataFrame:
    e = drawdown_episodes(returns, key)
    e = e.withColumn("k", F.row_number().over(Window.partitionBy(key).orderBy("depth", "start"))).where(F.col("k") <= deepest)
    growth = returns.groupBy(key).agg(m.cagr("r").alias("g"))
    out = e.groupBy(key).agg(F.avg(F.abs("depth")).alias("a"), F.sqrt(F.avg(F.col("depth") ** 2)).alias("b")).join(growth, key)
    return out.select(key, F.try_divide("g", "a").alias("sterling"), F.try_divide("g", "b").alias("burke"))


def unbiased_moments(n, g1, g2):
    """Sample skewness and excess kurtosis from the biased ones."""
    n = n.cast("double")
    return g1 * F.sqrt(n * (n - 1)) / (n - 2), ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3))


def cornish_fisher(returns: DataFrame, key: str = "run_id", alpha: float = 0.05) -> DataFrame:
    z = NormalDist().inv_cdf(alpha)
    d = returns.groupBy(key).agg(F.count("r").alias("n"), F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("s"), F.kurtosis("r").alias("k"), F.percentile("r", F.lit(alpha)).alias("q"))
    s, k = unbiased_moments(F.col("n"), F.col("s"), F.col("k"))
    value = F.col("mu") + F.col("sd") * (z + (z * z - 1) * s / 6 + (z**3 - 3 * z) * k / 24 - (2 * z**3 - 5 * z) * s * s / 36)
    return d.select(key, F.when(F.col("n") < 4, F.col("q")).otherwise(value).alias("cornish_fisher"))
