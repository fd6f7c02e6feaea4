"""Trading rules: target weights from long prices (symbol, dt, price) or session returns from intraday bars.

Stateless rules are windows. A rule whose state is "the last event decides" is a last non-null value over the events.
Rules with a longer memory fold one symbol's bars in order inside one group; symbols are parallel.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import along, ffill, pct_change, rolling
from .signals import ewm

YEAR = 252


def ma_crossover(prices: DataFrame, fast: int = 20, slow: int = 100) -> DataFrame:
    """w = 1 while the fast mean is above the slow one, else -1; 0 until the slow one has all its bars."""
    w = along("symbol")
    f, s = rolling(F.col("price"), fast, w), rolling(F.col("price"), slow, w)
    return prices.withColumn("w", F.when(s.isNull(), 0.0).when(f > s, 1.0).otherwise(-1.0))


def month_end_trend(prices: DataFrame, months: int = 10) -> DataFrame:
    """(month, symbol, w): equal weight among the symbols whose month-end price is above its mean over `months` month ends."""
    m = prices.groupBy("symbol", F.trunc("dt", "MM").alias("month")).agg(F.max_by("price", "dt").alias("price"))
    mean = rolling(F.col("price"), months, along("symbol", "month"))
    m = m.withColumn("on", F.coalesce((F.col("price") > mean).cast("int"), F.lit(0)))
    return m.select("month", "symbol", F.coalesce(F.try_divide(F.col("on"), F.sum("on").over(Window.partitionBy("month"))), F.lit(0.0)).alias("w"))


def momentum_weights(prices: DataFrame, lookback: int = YEAR, vol_window: int = 60, target: float = 0.10, cap: float = 0.15, gross_cap: float = 2.0, floor: float = 0.02) -> DataFrame:
    """(month, symbol, w) at month ends: long the symbols that rose over `lookback` bars, by inverse volatility, scaled to the
    target volatility (correlations ignored), each capped, the sum capped."""
    w, day = along("symbol"), Window.partitionBy("month")
    p = prices.withColumn("ret", pct_change("price", w))
    vol = F.greatest(rolling(F.col("ret"), vol_window, w, F.stddev_samp) * F.sqrt(F.lit(float(YEAR))), F.lit(floor))
    p = p.withColumn("vol", vol).withColumn("rise", F.col("price") / F.lag("price", lookback).over(w) - 1)
    last = F.row_number().over(Window.partitionBy("symbol", F.trunc("dt", "MM")).orderBy(F.desc("dt")))
    m = p.withColumn("k", last).where("k = 1 and rise is not null and vol is not null").withColumn("month", F.trunc("dt", "MM"))
    m = m.withColumn("raw", F.when(F.col("rise") > 0, 1 / F.col("vol")).otherwise(0.0))
    port = F.sqrt(F.sum(F.pow(F.col("raw") * F.col("vol"), 2)).over(day))
    m = m.withColumn("w", F.when(port < 1e-8, 0.0).otherwise(F.least(F.col("raw") * target / port, F.lit(cap))))
    gross = F.sum("w").over(day)
    return m.withColumn("w", F.when(gross > gross_cap, F.col("w") * gross_cap / gross).otherwise(F.col("w"))).select("month", "symbol", "w")


def channel_breakout(prices: DataFrame, enter: int = 20, leave: int = 10) -> DataFrame:
    """w = 1 from a close above the highest of the `enter` bars before until one below the lowest of the `leave` bars before."""
    w = along("symbol")
    before = lambda n, f: F.when(F.count("price").over(w.rowsBetween(-n, -1)) >= n, f("price").over(w.rowsBetween(-n, -1)))
    event = F.when(F.col("price") > before(enter, F.max), 1.0).when(F.col("price") < before(leave, F.min), 0.0)
    return prices.withColumn("event", event).withColumn("w", F.coalesce(ffill("event", w), F.lit(0.0))).drop("event")


def banded_side(bars: DataFrame, band: float, keys: tuple[str, ...] = ("symbol", "session"), order: str = "bar") -> DataFrame:
    """The side of close against vwap with hysteresis: it flips only past the band; a session's first bar sets it."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.col("close") - F.col("vwap")
    first = F.when(F.row_number().over(w) == 1, F.when(gap >= 0, 1.0).otherwise(-1.0))
    d = bars.withColumn("_e", F.coalesce(F.when(F.abs(gap) > band, F.signum(gap)), first))
    return d.withColumn("side", ffill("_e", w)).drop("_e")


def sessions(bars: DataFrame) -> DataFrame:
    """(symbol, session): open, high, low, close, number of bars, and the second bar's open."""
    at = F.row_number().over(Window.partitionBy("symbol", "session").orderBy("bar"))
    return bars.withColumn("_n", at).groupBy("symbol", "session").agg(
        F.min_by("open", "bar").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"),
        F.count("*").alias("bars"), F.max(F.when(F.col("_n") == 2, F.col("open"))).alias("second_open"),
    )


def close_strength_reversion(bars: DataFrame, below: float = 0.2, cost_bps: float = 1.0, need: int = 5) -> DataFrame:
    """(symbol, session, r): open to close of sessions whose prior session closed in the lowest part of its range, less costs."""
    s = sessions(bars)
    w = along("symbol", "session")
    strength = F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))
    s = s.withColumn("prior", F.lag(strength).over(w))
    r = F.when((F.col("prior") < below) & (F.col("bars") >= need), F.col("close") / F.col("open") - 1 - 2 * cost_bps / 1e4).otherwise(0.0)
    return s.select("symbol", "session", r.alias("r"))


def overnight_reversal(bars: DataFrame, from_hour: int = 22, below: float = 0.0, cost_bps: float = 1.0) -> DataFrame:
    """(symbol, session, r): after a fall from the first to the last close of the late bars, from the close to the second open of
    the next session, booked on the session of entry."""
    late = bars.where(F.hour("bar") >= from_hour).groupBy("symbol", "session").agg((F.max_by("close", "bar") / F.min_by("close", "bar") - 1).alias("late"))
    s = sessions(bars).join(late, ["symbol", "session"], "left")
    w = along("symbol", "session")
    s = s.withColumn("fill", F.lead("second_open").over(w))
    r = F.when((F.col("late") < below) & F.col("fill").isNotNull(), F.col("fill") / F.col("close") - 1 - 2 * cost_bps / 1e4).otherwise(0.0)
    return s.select("symbol", "session", r.alias("r"))


def month_end_flow(wide: DataFrame, stock: str, bond: str, n_last: int = 5, cost_bps: float = 1.0) -> DataFrame:
    """(dt, r): on a month's last days, against the sign of the stock's lead over the bond from the month's first day to the day
    before those. wide: dt, stock and bond closes. Months of fewer than n_last + 2 days are flat."""
    m = Window.partitionBy(F.trunc("dt", "MM"))
    rn, n = F.row_number().over(m.orderBy("dt")), F.count("*").over(m)
    d = wide.withColumn("rn", rn).withColumn("n", n)
    at = lambda c, k: F.max(F.when(k, F.col(c))).over(m)
    eve, start = F.col("rn") == F.col("n") - n_last, F.col("rn") == 1
    lead = at(stock, eve) / at(stock, start) - at(bond, eve) / at(bond, start)
    # one calendar is one ordered sequence of days
    ret = F.col(stock) / F.lag(stock).over(Window.partitionBy(F.lit(1)).orderBy("dt")) - 1
    d = d.withColumn("side", -F.signum(lead)).withColumn("ret", ret)
    on = (F.col("n") >= n_last + 2) & (F.col("rn") > F.col("n") - n_last) & (F.col("side") != 0)
    return d.select("dt", F.when(on, F.col("side") * F.col("ret") - cost_bps / 1e4).otherwise(0.0).alias("r"))


def _per_symbol(prices: DataFrame, f, columns: list[str], out: str) -> DataFrame:
    t = prices.schema
    schema = ", ".join([*(f"{c} {t[c].dataType.simpleString()}" for c in ("symbol", "dt", "price")), out])

    def one(pdf):
        return f(pdf.sort_values("dt", ignore_index=True))

    return prices.select("symbol", "dt", *columns).groupBy("symbol").applyInPandas(one, schema)


def dual_ema(prices: DataFrame, fast: int = 20, slow: int = 50, trend: int = 100, short: bool = False) -> DataFrame:
    """w follows crossings of two exponential means while the price is on the same side of its long mean.

    A side opens where both agree with it and one of them has just turned, and closes where either turns against it. As
    what opens one side always closes the other, each side is the last of its own events.
    """
    w = along("symbol")
    d = prices.select("symbol", "dt", "price")
    for name, span in (("quick", fast), ("calm", slow)):
        d = d.join(ewm(prices, "symbol", "price", 2 / (span + 1)).withColumnRenamed("ewm", name), ["symbol", "dt"])
    side = F.when(F.col("price") > F.col("mean"), 1).when(F.col("price") <= F.col("mean"), -1).otherwise(0)
    d = d.withColumn("mean", rolling(F.col("price"), trend, w)).withColumn("macro", side).withColumn("lead", F.when(F.col("quick") > F.col("calm"), 1).otherwise(-1))
    d = d.withColumn("crossed", F.col("lead") != F.lag("lead").over(w)).withColumn("turned", F.col("macro") == -F.lag("macro").over(w))

    def held(k: int):
        opens = (F.col("macro") == k) & (F.col("lead") == k) & (F.col("crossed") | F.col("turned"))
        closes = F.col("crossed").isNotNull() & ((F.col("macro") == -k) | (F.col("crossed") & (F.col("lead") == -k)))
        return F.coalesce(ffill(F.when(opens, 1.0).when(closes, 0.0), w), F.lit(0.0))

    return d.select("symbol", "dt", "price", (held(1) - held(-1) if short else held(1)).alias("w"))


def squeeze_breakout(prices: DataFrame, n: int = 20, k: float = 2.0, quiet: int = 126) -> DataFrame:
    """After a bar of nearly the narrowest bands in `quiet` bars, a close outside the bands opens, one across the mean closes.

    Which breakouts count depends on the trades before them, so each symbol's trades are found in turn: the next close
    outside the bands that has a narrow bar since the last opening, then the next close across the mean.
    """
    w = along("symbol")
    d = prices.select("symbol", "dt", "price").withColumn("mid", rolling(F.col("price"), n, w)).withColumn("half", k * rolling(F.col("price"), n, w, F.stddev_samp))
    d = d.withColumn("width", 2 * F.col("half") / F.col("mid")).withColumn("tight", F.coalesce(F.col("width") <= rolling(F.col("width"), quiet, w, F.min) * 1.05, F.lit(False)))

    def trades(pdf):
        pdf = pdf.sort_values("dt", ignore_index=True)
        off = (pdf.price - pdf.mid).to_numpy(float)
        outside, narrow = np.flatnonzero(np.abs(off) > pdf.half.to_numpy(float)), np.flatnonzero(pdf.tight)
        held, free = np.zeros(len(pdf)), 0  # free: the first bar at which a trade may open; opened: the last opening
        opened = 0
        while (at := np.searchsorted(narrow, opened)) < len(narrow):
            at = np.searchsorted(outside, max(free, narrow[at] + 1))
            if at == len(outside):
                break
            opened = outside[at]
            side = np.sign(off[opened])
            against = np.flatnonzero(off[opened + 1 :] * side < 0)
            end = opened + 1 + against[0] if len(against) else len(pdf)
            held[opened:end], free = side, end + 1
        pdf["w"] = held
        return pdf[["symbol", "dt", "price", "w"]]

    t = prices.schema
    return d.groupBy("symbol").applyInPandas(trades, ", ".join(f"{x} {t[x].dataType.simpleString()}" for x in ("symbol", "dt", "price")) + ", w double")


def extreme_reversion(prices: DataFrame, enter: float = 2.0, leave: float = 0.5, trend: int = 50) -> DataFrame:
    """prices has a score z (null: keep the position): short at z >= enter above the mean, long at z <= -enter below it,
    flat once |z| <= leave."""

    def f(p):
        mean = p.price.rolling(trend).mean().to_numpy()
        x, z = p.price.to_numpy(), p.z.to_numpy(float)
        out, now = np.zeros(len(p)), 0.0
        for i in range(len(p)):
            if not (np.isnan(z[i]) or np.isnan(mean[i])):
                if now == 0:
                    now = -1.0 if z[i] >= enter and x[i] > mean[i] else 1.0 if z[i] <= -enter and x[i] <= mean[i] else 0.0
                elif abs(z[i]) <= leave:
                    now = 0.0
            out[i] = now
        return p.drop(columns="z").assign(w=out)

    return _per_symbol(prices, f, ["price", "z"], "w double")


def wilder_rsi(prices: DataFrame, n: int = 2) -> DataFrame:
    """(symbol, dt, price, rsi) from Wilder's exponential means of gains and losses."""

    def f(p):
        step = p.price.diff()
        mean = lambda x: x.clip(lower=0).ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
        gain, loss = mean(step), mean(-step)
        return p.assign(rsi=np.where(gain + loss > 0, 100 * gain / (gain + loss), np.nan))

    return _per_symbol(prices, f, ["price"], "rsi double")


def oversold(prices: DataFrame, n: int = 2, below: float = 10.0, above: float = 70.0, trend: int = 200) -> DataFrame:
    """w = 1 from an oversold close above the long mean until the index has recovered: the last event decides."""
    w = along("symbol")
    d = wilder_rsi(prices, n).withColumn("mean", rolling(F.col("price"), trend, w))
    event = F.when((F.col("rsi") < below) & (F.col("price") > F.col("mean")), 1.0).when(F.col("rsi") > above, 0.0)
    return d.withColumn("event", event).select("symbol", "dt", "price", F.coalesce(ffill("event", w), F.lit(0.0)).alias("w"))


def directional_index(bars: DataFrame, n: int = 14) -> DataFrame:
    """(symbol, bar, adx): Wilder's average directional index over a symbol's bars, across sessions."""

    def f(pdf):
        p = pdf.sort_values("bar", ignore_index=True)
        wilder = lambda x: x.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
        up, down, prev = p.high.diff(), -p.low.diff(), p.close.shift()
        span = pd.concat([p.high - p.low, (p.high - prev).abs(), (p.low - prev).abs()], axis=1).max(axis=1)
        atr = wilder(span)
        plus = 100 * wilder(up.where((up > down) & (up > 0), 0.0)) / atr
        minus = 100 * wilder(down.where((down > up) & (down > 0), 0.0)) / atr
        total = plus + minus
        return p[["symbol", "bar"]].assign(adx=wilder(100 * (plus - minus).abs() / total.where(total > 0)))

    return bars.select("symbol", "bar", "high", "low", "close").groupBy("symbol").applyInPandas(f, "symbol string, bar timestamp, adx double")
