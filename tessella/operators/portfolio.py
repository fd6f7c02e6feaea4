"""Factor, pairwise and portfolio operators over long returns (run_id, dt, r)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import along, rolling


def beta_capture(wide: DataFrame, y: str, x: str) -> DataFrame:
    """Alpha, beta, R2, up/down capture and one-sided betas of y on the benchmark x."""
    up, down = F.col(x) > 0, F.col(x) < 0
    one = lambda cond: F.regr_slope(F.when(cond, F.col(y)), F.when(cond, F.col(x)))
    share = lambda cond: F.try_divide(F.avg(F.when(cond, F.col(y))), F.avg(F.when(cond, F.col(x))))
    return wide.agg(
        F.count("*").alias("n"), F.regr_intercept(y, x).alias("alpha"), F.regr_slope(y, x).alias("beta"), F.regr_r2(y, x).alias("r2"),
        share(up).alias("up_capture"), share(down).alias("down_capture"), one(up).alias("beta_up"), one(down).alias("beta_down"),
    )


def pair_correlations(returns: DataFrame) -> DataFrame:
    """Correlation of every pair of runs on their common dates: an equi-join on the date, runs are few per date."""
    a, b = (returns.select("dt", F.col("run_id").alias(f"{k}_id"), F.col("r").alias(k)) for k in "ab")
    return a.join(b, "dt").where("a_id < b_id").groupBy("a_id", "b_id").agg(F.count("*").alias("n"), F.corr("a", "b").alias("corr"))


def inverse_vol(returns: DataFrame) -> DataFrame:
    d = returns.groupBy("run_id").agg((1 / F.stddev_samp("r")).alias("i"))
    return d.crossJoin(d.agg(F.sum("i").alias("total"))).select("run_id", (F.col("i") / F.col("total")).alias("w"))


def concentration(holdings: DataFrame, value: str) -> DataFrame:
    """Herfindahl index and the effective number of holdings: sums only, no pass over normalised weights."""
    s, q = F.sum(value), F.sum(F.col(value) ** 2)
    return holdings.agg(F.count("*").alias("n"), (q / s / s).alias("hhi"), (s * s / q).alias("effective"))


def covariances(returns: DataFrame) -> DataFrame:
    a, b = (returns.select("dt", F.col("run_id").alias(f"{k}_id"), F.col("r").alias(k)) for k in "ab")
    return a.join(b, "dt").groupBy("a_id", "b_id").agg(F.covar_samp("a", "b").alias("cov"))


def euler_risk(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Each run's contribution to the portfolio's volatility, and its share."""
    c = covariances(returns).join(weights.select(F.col("run_id").alias("a_id"), F.col("w").alias("wa")), "a_id").join(weights.select(F.col("run_id").alias("b_id"), F.col("w").alias("wb")), "b_id")
    part = c.groupBy(F.col("a_id").alias("run_id")).agg(F.sum(F.col("wa") * F.col("wb") * F.col("cov")).alias("p"))
    total = part.agg(F.sum("p").alias("total"))
    return part.crossJoin(total).select("run_id", (F.col("p") / F.sqrt("total")).alias("contribution"), (F.col("p") / F.col("total")).alias("share"))


def active_share(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Portfolio return per date, weights rescaled over the runs that have a return that day."""
    d = returns.where("r is not null").join(weights, "run_id")
    return d.groupBy("dt").agg(F.count("*").alias("active"), F.try_divide(F.sum(F.col("w") * F.col("r")), F.sum("w")).alias("r"))


def serial_tests(returns: DataFrame, lags: int = 5, horizon: int = 5) -> DataFrame:
    """Ljung-Box statistic, variance ratio, Durbin-Watson and first autocorrelation per run, from one window order."""
    w, all_ = along("run_id"), Window.partitionBy("run_id")
    d = returns.withColumn("d", F.col("r") - F.avg("r").over(all_)).withColumn("prev", F.lag("r").over(w)).withColumn("rq", rolling(F.col("r"), horizon, w, F.sum))
    for k in range(1, lags + 1):
        d = d.withColumn(f"e{k}", F.lag("d", k).over(w))
    ss = F.sum(F.col("d") ** 2)
    acf = [F.sum(F.col("d") * F.col(f"e{k}")) / ss for k in range(1, lags + 1)]
    n = F.count("*")
    box = sum((a * a / (n - k) for k, a in enumerate(acf, 1)), F.lit(0.0)) * n * (n + 2)
    return d.groupBy("run_id").agg(box.alias("ljung_box"), (F.var_samp("rq") / (horizon * F.var_samp("r"))).alias("variance_ratio"), (F.sum((F.col("r") - F.col("prev")) ** 2) / F.sum(F.col("r") ** 2)).alias("durbin_watson"), acf[0].alias("acf1"))
