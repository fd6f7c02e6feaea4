"""Weights to returns, the position ledger, and the drawdown family."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m

from .panel import along, ffill, islands, pct_change, rolling


def simulate_weights(panel: DataFrame, keys: Sequence[str] = ("run_id",), cost_bps: float = 10.0) -> DataFrame:
    """Returns of target weights. panel: keys, symbol, dt, price, w (null: carry the last target).

    The weight of the bar before earns a bar's return; turnover is charged on the bar of the decision; a symbol's first
    bar is dropped and its opening position is free. Gives keys, dt, r, gross, cost.
    """
    w = along([*keys, "symbol"])
    p = panel.withColumn("w", F.coalesce(ffill("w", w), F.lit(0.0)))
    p = p.withColumn("held", F.lag("w").over(w)).withColumn("ret", pct_change("price", w)).withColumn("n", F.row_number().over(w))
    p = p.where("n > 1")
    gross, cost = F.sum(F.col("held") * F.coalesce("ret", F.lit(0.0))), F.sum(F.abs(F.col("w") - F.col("held"))) * F.lit(cost_bps / 1e4)
    out = p.groupBy(*keys, "dt").agg(gross.alias("gross"), cost.alias("cost"))
    return out.withColumn("r", F.col("gross") - F.col("cost"))


def equity(returns: DataFrame, keys: str | Sequence[str], r: str = "r") -> DataFrame:
    """Adds the log equity and the drawdown below its running peak. Starting capital is no peak."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    w = along(keys).rowsBetween(Window.unboundedPreceding, 0)
    out = returns.where(F.col(r).isNotNull()).withColumn("log_equity", F.sum(F.log1p(r)).over(w))
    return out.withColumn("drawdown", F.expm1(F.col("log_equity") - F.max("log_equity").over(w)))


def core_metrics(returns: DataFrame, keys: Sequence[str] = ("run_id",), ppy: float = m.PPY, r: str = "r") -> DataFrame:
    """One row per run: the core metrics, from one pass of windows and one aggregation."""
    clean = returns.withColumn(r, m.finite(r))
    out = equity(clean, keys, r).groupBy(*keys).agg(
        F.count(r).alias("n"), m.sharpe(r, ppy).alias("sharpe"), m.volatility(r, ppy).alias("volatility"), m.cagr(r, ppy).alias("cagr"),
        m.sortino(r, ppy).alias("sortino"), m.win_rate(r).alias("win_rate"), m.expected_value(r).alias("expected_value"),
        m.skewness(r).alias("skewness"), m.kurtosis(r).alias("kurtosis"), m.gaussian_var(r).alias("gaussian_var"),
        F.coalesce(F.min("drawdown"), F.lit(0.0)).alias("max_drawdown"),
    )
    return out.withColumn("calmar", F.when(F.abs("max_drawdown") < 1e-12, 0.0).otherwise(F.try_divide(F.col("cagr"), F.abs("max_drawdown"))))


def drawdown_episodes(returns: DataFrame, key: str) -> DataFrame:
    """(key, episode, start, end, bars, depth) of every stretch under water."""
    e = islands(equity(returns, key).withColumn("under", F.col("drawdown") < 0), key, "under")
    out = e.where("under").groupBy(key, "island").agg(F.min("dt").alias("start"), F.max("dt").alias("end"), F.count("*").alias("bars"), F.min("drawdown").alias("depth"))
    return out.withColumn("episode", F.row_number().over(Window.partitionBy(key).orderBy("start"))).drop("island")


def top_drawdowns(returns: DataFrame, n: int, key: str = "run_id") -> DataFrame:
    """The n deepest episodes of every key: start, trough, first day back at the peak (null while it lasts), bars in all and to the trough."""
    w = along(key)
    e = equity(returns, key).withColumn("under", F.col("drawdown") < -1e-10)
    e = e.withColumn("next_dt", F.lead("dt").over(w)).withColumn("i", F.row_number().over(w))
    d = islands(e, key, "under").where("under").groupBy(key, "island").agg(
        F.min("dt").alias("start_dt"), F.max_by("next_dt", "dt").alias("recovery_dt"), F.min_by("dt", F.struct("drawdown", "dt")).alias("trough_dt"),
        F.count("*").alias("bars"), (F.min_by("i", F.struct("drawdown", "dt")) - F.min("i")).alias("to_trough"), F.min("drawdown").alias("depth"),
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy("depth", "start_dt"))
    return d.withColumn("rank", rank).where(F.col("rank") <= n).drop("island")


def position_ledger(weights: DataFrame, key: Sequence[str] = ("run_id", "symbol")) -> DataFrame:
    """One row per spell of a held position: entry, exit, bars, weights, rebalances, contribution and excursions.

    weights: key, dt, w, ret. A spell lasts until the weight is zero; a change of sign is a rebalance within it, and the
    side is that of the mean weight. Every bar earns the weight held before it times its return.
    """
    w = along(list(key))
    p = weights.withColumn("on", F.abs("w") > 1e-12).withColumn("pnl", F.coalesce(F.lag("w").over(w) * F.col("ret"), F.lit(0.0)))
    p = islands(p, list(key), "on").where("on")
    spell = along([*key, "island"])
    p = p.withColumn("cum", F.sum("pnl").over(spell.rowsBetween(Window.unboundedPreceding, 0))).withColumn("moved", F.abs(F.col("w") - F.lag("w").over(spell)) > 1e-12)
    d = p.groupBy(*key, "island").agg(
        F.min("dt").alias("entry"), F.max("dt").alias("exit"), F.count("*").alias("bars"), F.avg("w").alias("avg_weight"), F.max(F.abs("w")).alias("max_weight"), F.count_if("moved").alias("rebalances"),
        F.sum("pnl").alias("contribution"), F.least(F.min("cum"), F.lit(0.0)).alias("mae"), F.greatest(F.max("cum"), F.lit(0.0)).alias("mfe"),
    ).drop("island")
    return d.withColumn("side", F.when(F.col("avg_weight") > 0, "long").otherwise("short"))


def sma_rule(prices: DataFrame, n: Column | int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """w = 1 while the close is above its n-bar mean (0 until that has n bars)."""
    w = along(list(keys))
    return prices.withColumn("w", F.coalesce((F.col("price") > rolling(F.col("price"), n, w)).cast("double"), F.lit(0.0)))
