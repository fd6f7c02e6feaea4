"""Queries: panels, bars, cross-section, signals, labels, regimes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.operators import panel, signals

from .inference import cdf
from .registry import query


@query("symbol session bar", "trades", "open high low close volume", "SELECT * FROM bars", "ticks bars")
def ohlcv_bars(v):
    return v.bars


@query("symbol session", "trades", "buy_vol sell_vol delta", "SELECT symbol, session, count(*) AS trades, coalesce(sum(qty) FILTER (side = 'buy'), 0) AS buy_vol, coalesce(sum(qty) FILTER (side = 'sell'), 0) AS sell_vol, coalesce(sum(qty) FILTER (side = 'buy'), 0) - coalesce(sum(qty) FILTER (side = 'sell'), 0) AS delta FROM ticks GROUP BY 1, 2", "ticks")
def order_flow_bars(v):
    return panel.order_flow(v.ticks, F.col("session")).withColumnRenamed("bar", "session")


@query("symbol session bar", "", "vwap band", """SELECT symbol, session, bar, vwap, stddev_samp(close - vwap) OVER w AS band FROM (SELECT *, sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w AS vwap FROM bars WINDOW w AS (PARTITION BY symbol, session ORDER BY bar))
    WINDOW w AS (PARTITION BY symbol, session ORDER BY bar)""", "ticks bars", places=6)  # fmt: skip
def session_vwap(v):
    return panel.session_vwap(v.bars)


@query("dt", "members", "", """SELECT dt, count(*) AS members FROM (SELECT DISTINCT dt FROM px) JOIN spans ON dt BETWEEN start_dt AND coalesce(end_dt, (SELECT max(dt) FROM px)) GROUP BY dt""", "px spans")
def membership_counts(v):
    days = v.px.select("dt").distinct()
    return panel.members_on(v.spans, days, "start_dt", "end_dt").groupBy("dt").agg(F.count("*").alias("members"))


@query("symbol ts", "tick_id", "price asof_close", """SELECT t.symbol, t.ts, t.tick_id, t.price, b.close AS asof_close FROM ticks t ASOF LEFT JOIN (SELECT symbol, bar + INTERVAL 1 HOUR AS ts, close FROM bars) b ON t.symbol = b.symbol AND t.ts >= b.ts""", "ticks bars")
def asof_fill(v):
    closes = v.bars.select("symbol", (F.col("bar") + F.expr("interval 1 hour")).alias("ts"), "close")
    left = v.ticks.select("symbol", "ts", "tick_id", "price")
    return panel.asof_join(left, closes, ["symbol"], "ts", ["close"]).withColumnRenamed("close", "asof_close")


@query("symbol dt", "", "price filled", """SELECT symbol, dt, p.price, last_value(p.price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt) AS filled FROM
    (SELECT symbol, dt FROM (SELECT DISTINCT symbol FROM px) CROSS JOIN (SELECT DISTINCT dt FROM px)) LEFT JOIN px p USING (symbol, dt)""", "px")  # fmt: skip
def calendar_fill(v):
    days, names = v.px.select("dt").distinct(), v.px.select("symbol").distinct()
    # one row per symbol and trading day, the size of the panel itself
    grid = days.crossJoin(names).join(v.px, ["symbol", "dt"], "left")
    return grid.withColumn("filled", panel.ffill("price", panel.along("symbol")))


@query("symbol dt", "", "w", """SELECT symbol, dt, CASE WHEN rn > n - least(2, n) THEN 1.0 / least(2, n) WHEN n >= 2 * least(2, n) AND rn <= least(2, n) THEN -1.0 / least(2, n) ELSE 0.0 END AS w
    FROM (SELECT *, count(*) OVER (PARTITION BY dt) AS n, row_number() OVER (PARTITION BY dt ORDER BY signal, symbol) AS rn FROM sig WHERE signal IS NOT NULL)""", "px pr sig")  # fmt: skip
def topk_basket(v):
    return signals.long_short(v.sig, 2)


@query("", "n", "mean_ic std_ic icir t_stat pct_positive", """SELECT count(*) AS n, avg(ic) AS mean_ic, stddev_samp(ic) AS std_ic, avg(ic) / stddev_samp(ic) AS icir, avg(ic) / stddev_samp(ic) * sqrt(count(*)) AS t_stat, avg(CAST(ic > 0 AS DOUBLE)) AS pct_positive FROM (
    SELECT dt, round(corr(rs, rf), 12) AS ic, count(*) AS c FROM (SELECT dt, rank() OVER (PARTITION BY dt ORDER BY signal) + (count(*) OVER (PARTITION BY dt, signal) - 1) / 2.0 AS rs, rank() OVER (PARTITION BY dt ORDER BY fwd) + (count(*) OVER (PARTITION BY dt, fwd) - 1) / 2.0 AS rf
    FROM sig WHERE signal IS NOT NULL AND fwd IS NOT NULL) GROUP BY dt) WHERE c >= 5 AND ic IS NOT NULL""", "px pr sig", places=6)  # fmt: skip
def rank_ic(v):
    return signals.ic_summary(signals.information_coefficient(v.sig))


@query("symbol", "", "xi", """SELECT symbol, 1 - any_value(n) * sum(abs(nx - r)) / (2.0 * sum(l * (n - l))) AS xi FROM (SELECT *, lead(r) OVER (PARTITION BY symbol ORDER BY signal, dt) AS nx FROM (
    SELECT symbol, dt, signal, count(*) OVER (PARTITION BY symbol ORDER BY fwd) AS r, count(*) OVER (PARTITION BY symbol ORDER BY fwd DESC) AS l, count(*) OVER (PARTITION BY symbol) AS n FROM sig WHERE signal IS NOT NULL AND fwd IS NOT NULL)) GROUP BY symbol""", "px pr sig")  # fmt: skip
def xi_ic(v):
    return signals.xi_correlation(v.sig, "symbol", "signal", "fwd")


@query("symbol", "n", "xi p_value", f"""SELECT symbol, n, xi, {cdf("(-xi * sqrt(n) / sqrt(0.4e0))")} AS p_value FROM (SELECT symbol, any_value(n) AS n, 1 - any_value(n) * sum(abs(nx - r)) / (2.0 * sum(l * (n - l))) AS xi FROM (SELECT *, lead(r) OVER (PARTITION BY symbol ORDER BY signal, dt) AS nx FROM (
    SELECT symbol, dt, signal, count(*) OVER (PARTITION BY symbol ORDER BY fwd) AS r, count(*) OVER (PARTITION BY symbol ORDER BY fwd DESC) AS l, count(*) OVER (PARTITION BY symbol) AS n FROM sig WHERE signal IS NOT NULL AND fwd IS NOT NULL)) GROUP BY symbol)""", "px pr sig", places=6)  # fmt: skip
def xi_significance(v):
    return signals.xi_significance(v.sig, "symbol", "signal", "fwd")


@query("symbol dt", "regime", "", "SELECT symbol, dt, CASE WHEN count(*) OVER w >= 200 AND price > avg(price) OVER w THEN 1 ELSE 0 END AS regime FROM px WINDOW w AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)", "px")
def trend_regime(v):
    return signals.trend_regime(v.px)


@query("symbol dt", "regime", "price", "SELECT symbol, dt, price, CASE WHEN price >= 110 THEN 2 WHEN price <= 100 THEN 0 ELSE 1 END AS regime FROM px", "px")
def level_regime(v):
    return signals.level_regime(v.px, "price", 100.0, 110.0)


@query("symbol", "bucket n", "mean_fwd", "SELECT symbol, bucket, count(*) AS n, avg(fwd) AS mean_fwd FROM (SELECT *, ntile(5) OVER (PARTITION BY symbol ORDER BY signal, dt) AS bucket FROM sig WHERE signal IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1, 2", "px pr sig")
def bucket_returns(v):
    return signals.buckets(v.sig)


@query("dt symbol", "bucket", "", """SELECT symbol, dt, 1 + CAST(signal > q1 AS INT) + CAST(signal > q2 AND q2 > q1 AS INT) + CAST(signal > q3 AND q3 > q2 AS INT) + CAST(signal > q4 AND q4 > q3 AS INT) AS bucket FROM sig JOIN (
    SELECT dt, min(signal) AS q0, quantile_cont(signal, 0.2) AS q1, quantile_cont(signal, 0.4) AS q2, quantile_cont(signal, 0.6) AS q3, quantile_cont(signal, 0.8) AS q4 FROM sig WHERE signal IS NOT NULL GROUP BY dt HAVING count(*) = 5) USING (dt) WHERE signal IS NOT NULL""", "px pr sig")  # fmt: skip
def quintile_buckets(v):
    full = v.sig.where("signal is not null").withColumn("c", F.count("*").over(Window.partitionBy("dt"))).where("c = 5")
    return signals.quantile_edges(full)


@query("dt", "", "turnover", """SELECT dt, sum(abs(w - coalesce(pw, 0))) AS turnover FROM (SELECT dt, w, lag(w) OVER (PARTITION BY symbol ORDER BY dt) AS pw FROM (
    SELECT symbol, dt, CASE WHEN rn > n - least(2, n) THEN 1.0 / least(2, n) WHEN n >= 2 * least(2, n) AND rn <= least(2, n) THEN -1.0 / least(2, n) ELSE 0.0 END AS w
    FROM (SELECT *, count(*) OVER (PARTITION BY dt) AS n, row_number() OVER (PARTITION BY dt ORDER BY signal, symbol) AS rn FROM sig WHERE signal IS NOT NULL))) GROUP BY dt""", "px pr sig")  # fmt: skip
def signal_turnover(v):
    return signals.turnover(signals.long_short(v.sig, 2))


@query("symbol", "lag n", "corr", "SELECT symbol, k AS lag, count(*) AS n, corr(signal, f) AS corr FROM (SELECT symbol, k, signal, lead(ret, k) OVER (PARTITION BY symbol, k ORDER BY dt) AS f FROM sig, (VALUES (1), (2), (5), (10)) t(k)) WHERE signal IS NOT NULL AND f IS NOT NULL GROUP BY 1, 2", "px pr sig")
def signal_decay(v):
    w = panel.along("symbol")
    ahead = F.array(*[F.struct(F.lit(k).alias("lag"), F.lead("ret", k).over(w).alias("f")) for k in (1, 2, 5, 10)])
    d = v.sig.withColumn("a", ahead).select("symbol", "signal", F.inline("a")).where("signal is not null and f is not null")
    return d.groupBy("symbol", "lag").agg(F.count("*").alias("n"), F.corr("signal", "f").alias("corr"))


@query("symbol dt", "", "neutral", "SELECT symbol, dt, signal - avg(signal) OVER (PARTITION BY dt, left(symbol, 1) <= '2') AS neutral FROM sig WHERE signal IS NOT NULL", "px pr sig", places=12)
def sector_neutral(v):
    return signals.neutralise(v.sig.where("signal is not null").withColumn("sector", F.substring("symbol", 1, 1) <= "2"), "sector")


@query("run_id regime", "n", "sharpe mean", """SELECT run_id, regime, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, avg(r) AS mean FROM (SELECT run_id, r, CASE WHEN vol <= q1 THEN 'low' WHEN vol <= q2 THEN 'mid' ELSE 'high' END AS regime FROM vols
    JOIN (SELECT run_id, quantile_cont(vol, 1.0/3) AS q1, quantile_cont(vol, 2.0/3) AS q2 FROM vols GROUP BY 1) USING (run_id) WHERE vol IS NOT NULL) GROUP BY 1, 2""".replace("FROM vols", "FROM (SELECT *, CASE WHEN count(r) OVER w >= 21 THEN stddev_samp(r) OVER w END AS vol FROM rets WINDOW w AS (PARTITION BY run_id ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)) vols"), "rets", places=6)  # fmt: skip
def regime_performance(v):
    d = signals.regimes(v.rets, "run_id").where("regime is not null")
    return d.groupBy("run_id", "regime").agg(F.count("*").alias("n"), m.sharpe("r").alias("sharpe"), F.avg("r").alias("mean"))


@query("run_id dt", "", "ewm", """WITH RECURSIVE n AS (SELECT run_id, dt, r, row_number() OVER (PARTITION BY run_id ORDER BY dt) AS i FROM rets), e AS (SELECT run_id, dt, i, r AS ewm FROM n WHERE i = 1
    UNION ALL SELECT n.run_id, n.dt, n.i, 0.1e0 * n.r + 0.9e0 * e.ewm FROM e JOIN n ON n.run_id = e.run_id AND n.i = e.i + 1) SELECT run_id, dt, ewm FROM e""", "rets")  # fmt: skip
def ewm_mean(v):
    return signals.ewm(v.rets, "run_id", "r", 0.1)


@query("symbol dt rule", "", "", """SELECT symbol, dt, rule FROM (SELECT symbol, bar AS dt, unnest([CASE WHEN high < low THEN 'high_below_low' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'nonpositive_price' END,
    CASE WHEN open NOT BETWEEN low AND high THEN 'open_outside' END, CASE WHEN close NOT BETWEEN low AND high THEN 'close_outside' END]) AS rule FROM (SELECT symbol, bar, open - 2 AS open, high - 40 AS high, low, close FROM bars)) WHERE rule IS NOT NULL""", "ticks bars")  # fmt: skip
def contract_violations(v):
    bad = v.bars.select("symbol", F.col("bar").alias("dt"), (F.col("open") - 2).alias("open"), (F.col("high") - 40).alias("high"), "low", "close", "volume")
    return panel.contract_violations(bad)
