"""Queries: breaks, predictive ability, scenarios, label weights, look-ahead, audit, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import diagnosis, panel, simulate, strategies

from .inference import chi2
from .registry import query


@query("run_id mean_at variance_at", "n mean_break variance_break", "mean_sup variance_sup", """SELECT run_id, max(n) AS n, max(bridge) AS mean_sup, arg_max(dt, bridge) AS mean_at, max(share) AS variance_sup, arg_max(dt, share) AS variance_at, max(bridge) > 1.36 AS mean_break, max(share) > 0.1 + 0.85 / sqrt(max(n)) AS variance_break FROM (
    SELECT run_id, dt, n, abs(sum(d) OVER w) / (sd * sqrt(n)) AS bridge, abs(sum(r * r) OVER w / q - i / n) AS share FROM (SELECT *, r - avg(r) OVER a AS d, stddev_samp(r) OVER a AS sd, sum(r * r) OVER a AS q, count(*) OVER a AS n, row_number() OVER (PARTITION BY run_id ORDER BY dt) AS i FROM rets WINDOW a AS (PARTITION BY run_id))
    WINDOW w AS (PARTITION BY run_id ORDER BY dt)) GROUP BY 1""", "rets", places=6)  # fmt: skip
def cusum_breaks(v):
    return diagnosis.cusum(v.rets)


@query("run_id", "windows", "slope_annual", """SELECT run_id, count(*) AS windows, regr_slope(s, i + 126) * 252 AS slope_annual FROM (SELECT run_id, avg(r) OVER w / stddev_samp(r) OVER w * sqrt(252) AS s, row_number() OVER (PARTITION BY run_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM rets
    WINDOW w AS (PARTITION BY run_id ORDER BY dt ROWS BETWEEN CURRENT ROW AND 251 FOLLOWING)) WHERE i % 63 = 0 AND i <= n - 252 AND n >= 504 GROUP BY 1 HAVING count(*) >= 3""", "rets", places=6)  # fmt: skip
def edge_decay(v):
    return diagnosis.edge_decay(v.rets)


@query("", "n", "mean_difference statistic", "SELECT count(*) AS n, avg(d) AS mean_difference, avg(d) / sqrt(var_pop(d) / count(*)) * sqrt((count(*) - 1) / count(*)) AS statistic FROM (SELECT abs(a) - abs(n) AS d FROM wide)", "rets wide", places=6)
def diebold_mariano(v):
    return diagnosis.diebold_mariano(v.wide.select(F.abs("a").alias("x"), F.abs("n").alias("y")), "x", "y")


@query("symbol", "n", "hit_rate expected statistic", """SELECT symbol, n, h AS hit_rate, e AS expected, (h - e) / sqrt(e * (1 - e) / n - (pow(2*p - 1, 2) * q * (1 - q) + pow(2*q - 1, 2) * p * (1 - p)) / n - 4 * p * q * (1 - p) * (1 - q) / (n * n)) AS statistic FROM (SELECT *, p * q + (1 - p) * (1 - q) AS e FROM (
    SELECT symbol, count(*) AS n, avg(CAST(fwd > 0 AS DOUBLE)) AS p, avg(CAST(signal > 0 AS DOUBLE)) AS q, avg(CAST((fwd > 0) = (signal > 0) AS DOUBLE)) AS h FROM sig WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY 1))""", "px pr sig", places=6)  # fmt: skip
def directional_accuracy(v):
    return diagnosis.pesaran_timmermann(v.sig, "symbol", "signal", "fwd")


@query("", "", "t_dominates t_dominated", """SELECT max(t) AS t_dominates, max(-t) AS t_dominated FROM (SELECT g, (max(d) FILTER (run_id = 'A') - max(d) FILTER (run_id = 'R')) / sqrt(greatest(sum(v), 1e-12)) AS t FROM (
    SELECT run_id, g, avg(greatest(x - r, 0)) AS d, var_pop(greatest(x - r, 0)) / count(*) AS v FROM (SELECT run_id, r FROM rets WHERE run_id IN ('A', 'R')), (SELECT g, lo + (hi - lo) * g / 79 AS x FROM (SELECT min(r) AS lo, max(r) AS hi FROM rets WHERE run_id IN ('A', 'R')), range(0, 80) t(g)) GROUP BY 1, 2) GROUP BY g)""", "rets", places=5)  # fmt: skip
def stochastic_dominance(v):
    return diagnosis.dominance(v.rets, "A", "R")


@query("", "n", "threshold mean hit_rate beta", """SELECT threshold, count(*) AS n, avg(a) AS mean, avg(CAST(a > 0 AS DOUBLE)) AS hit_rate, regr_slope(a, n) AS beta FROM (SELECT *, exp(e - greatest(max(e) OVER (ORDER BY dt), 0)) - 1 AS d FROM (SELECT *, sum(ln(1 + n)) OVER (ORDER BY dt) AS e FROM wide)) w, (VALUES (0.05), (0.1), (0.2)) t(threshold) WHERE d <= -threshold GROUP BY threshold""", "rets wide", places=6)
def drawdown_response(v):
    return diagnosis.drawdown_response(v.wide, "a", "n")


@query("", "n_stress", "stress calm change", """SELECT count(*) FILTER (n <= q) AS n_stress, corr(a, n) FILTER (n <= q) AS stress, corr(a, n) FILTER (n > q) AS calm, corr(a, n) FILTER (n <= q) - corr(a, n) FILTER (n > q) AS change FROM wide, (SELECT quantile_cont(n, 0.1) AS q FROM wide)""", "rets wide", places=6)
def stress_correlation(v):
    return diagnosis.calm_and_stress_correlation(v.wide, "a", "n")


@query("symbol dt", "", "label", "SELECT symbol, dt, CAST(sign(signal) = sign(f) AS INT) AS label FROM (SELECT *, lead(ret) OVER (PARTITION BY symbol ORDER BY dt) AS f FROM sig)", "px pr sig")
def meta_labels(v):
    return diagnosis.meta_labels(v.sig, "signal")


_EVENTS = "(SELECT symbol, dt, i FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS i FROM pr) WHERE abs(ret) > 0.005)"


UNIQUE = f"""SELECT symbol, dt, u / sum(u) OVER (PARTITION BY symbol) * count(*) OVER (PARTITION BY symbol) AS weight FROM (
    SELECT e.symbol, e.dt, avg(1 / c.live) AS u FROM {_EVENTS} e JOIN (SELECT b.symbol, b.i, greatest(count(x.i), 1) AS live FROM (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS i FROM pr) b LEFT JOIN {_EVENTS} x ON b.symbol = x.symbol AND b.i BETWEEN x.i AND x.i + 20 GROUP BY 1, 2) c
    ON e.symbol = c.symbol AND c.i BETWEEN e.i AND e.i + 20 GROUP BY 1, 2)"""  # fmt: skip


@query("symbol dt", "", "weight", UNIQUE, "px pr")
def label_uniqueness(v):
    return diagnosis.uniqueness(v.pr.where("abs(ret) > 0.005"), v.px)


@query("symbol", "n leaks", "change", "SELECT symbol, count(*) // 2 AS n, 0 AS change, false AS leaks FROM px GROUP BY 1", "px")
def lookahead_check(v):
    return diagnosis.lookahead(lambda p: strategies.channel_breakout(p), v.px)


@query("symbol", "n leaks", "change", """SELECT symbol, count(*) AS n, max(CASE WHEN i = k THEN abs(nxt / price * (CAST('0x' || substr(md5('7:' || symbol || ':' || d1), 1, 8) AS BIGINT) % 10000 / 10000.0e0 - 0.5e0)) ELSE 0 END) AS change, true AS leaks
    FROM (SELECT symbol, dt, price, lead(price) OVER w AS nxt, lead(dt) OVER w AS d1, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) // 2 AS k FROM px WINDOW w AS (PARTITION BY symbol ORDER BY dt)) WHERE i <= k GROUP BY 1""", "px")  # fmt: skip
def lookahead_leak(v):
    """A rule that weighs by tomorrow's price: only the last weight before the cutoff sees a scrambled price."""
    ahead = lambda p: p.withColumn("w", F.lead("price").over(panel.along("symbol")) / F.col("price"))
    return diagnosis.lookahead(ahead, v.px)


@query("a_id b_id finding", "n", "equal corr", """SELECT a.run_id AS a_id, b.run_id AS b_id, count(*) AS n, avg(CAST(abs(a.r - b.r) <= 1e-12 AS DOUBLE)) AS equal, corr(a.r, b.r) AS corr, CASE WHEN avg(CAST(abs(a.r - b.r) <= 1e-12 AS DOUBLE)) >= 0.99 THEN 'identical' WHEN corr(a.r, b.r) > 0.999 THEN 'correlated' END AS finding FROM rets a JOIN rets b ON a.dt = b.dt AND a.run_id < b.run_id GROUP BY 1, 2 HAVING count(*) >= 50""", "rets")
def audit_twins(v):
    return diagnosis.twins(v.rets)


@query("run_id metric status", "", "old new", """SELECT run_id, metric, old, new, CASE WHEN old IS NULL THEN 'ADDED' WHEN new IS NULL THEN 'REMOVED' WHEN new - old < -tol THEN 'REGRESSION' WHEN new - old > tol THEN 'IMPROVEMENT' ELSE 'UNCHANGED' END AS status FROM (
    SELECT run_id, unnest(['sharpe', 'volatility']) AS metric, unnest([so, vo]) AS old, unnest([sn, vn]) AS new, unnest([0.05, 0.01]) AS tol FROM (
      SELECT run_id, avg(r) FILTER (dt < DATE '1998-07-01') / stddev_samp(r) FILTER (dt < DATE '1998-07-01') * sqrt(252) AS so, avg(r) / stddev_samp(r) * sqrt(252) AS sn, stddev_samp(r) FILTER (dt < DATE '1998-07-01') * sqrt(252) AS vo, stddev_samp(r) * sqrt(252) AS vn FROM rets GROUP BY 1))""", "rets", places=6)  # fmt: skip
def regression_diff(v):
    old, new = simulate.core_metrics(v.rets.where("dt < date'1998-07-01'")), simulate.core_metrics(v.rets)
    return diagnosis.regression_diff(old, new, {"sharpe": 0.05, "volatility": 0.01})


@query("run_id dt", "", "r", """SELECT run_id, dt, r FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM rets) WHERE n <= 100 OR i = 0 OR floor(i * 99 / (n - 1)) <> floor((i - 1) * 99 / (n - 1))""", "rets")
def decimated_returns(v):
    return diagnosis.decimate(v.rets, 100)


@query("run_id", "", "win_rate payoff bet half continuous", """SELECT run_id, w AS win_rate, p AS payoff, greatest(w - (1 - w) / p, 0) AS bet, greatest(w - (1 - w) / p, 0) / 2 AS half, k AS continuous FROM (SELECT run_id, avg(CASE WHEN r <> 0 THEN CAST(r > 0 AS DOUBLE) END) AS w, avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0)) AS p, avg(r) / var_samp(r) AS k FROM rets GROUP BY 1)""", "rets", places=6)
def kelly_bets(v):
    return diagnosis.kelly(v.rets).withColumnRenamed("full", "bet")


@query("run_id", "", "bps net_sharpe", "SELECT run_id, bps, (avg(r) * 252 - 12 * bps / 1e4) / (stddev_samp(r) * sqrt(252)) AS net_sharpe FROM rets, (VALUES (0.0), (1), (2), (5), (10), (20), (50), (100)) t(bps) GROUP BY 1, 2", "rets", places=6)
def cost_sensitivity(v):
    return diagnosis.cost_levels(v.rets, 12.0)


@query("", "p_partkey", "spread impact", "SELECT p_partkey, least(greatest(50 - 5 * log10(1000 * p_size * p_retailprice), 1), 500) AS spread, least(0.02 * sqrt(p_retailprice / (1000 * p_size)) * 1e4, 500) AS impact FROM part")
def cost_models(v):
    adv = F.lit(1000) * F.col("p_size")
    return v.table("part").select("p_partkey", diagnosis.spread_bps(adv, F.col("p_retailprice")).alias("spread"), diagnosis.impact_bps(F.col("p_retailprice"), adv).alias("impact"))


@query("family different", "n", "statistic p_value", f"""WITH d AS (SELECT dt, (n * n - a * a) AS d, lag(n * n - a * a) OVER (ORDER BY dt) AS h FROM wide), z AS (SELECT d AS x, d * h AS y FROM d WHERE h IS NOT NULL),
    m AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_samp(x) AS xx, var_samp(y) AS yy, covar_samp(x, y) AS xy FROM z)
    SELECT 'all' AS family, n, {chi2('s', 2)} < 0.05 AS different, s AS statistic, {chi2('s', 2)} AS p_value FROM (SELECT n, n * (mx * mx * yy - 2 * mx * my * xy + my * my * xx) / (xx * yy - xy * xy) AS s FROM m)""", "rets wide", places=6)  # fmt: skip
def giacomini_white(v):
    """Squared returns of two runs as losses; the instruments are a constant and the difference of the date before."""
    d = v.wide.select(F.lit("all").alias("family"), "dt", (F.col("n") * F.col("n")).alias("x"), (F.col("a") * F.col("a")).alias("y"), F.lit(1.0).alias("one"))
    d = d.withColumn("before", F.lag(F.col("x") - F.col("y")).over(panel.along("family")))
    return diagnosis.giacomini_white(d, "family", "x", "y", ["one", "before"])


@query("symbol bar", "trades", "open high low close volume", """WITH e AS (SELECT symbol, unnest(generate_series(min(bar), max(bar), INTERVAL 1 HOUR)) AS bar FROM bars GROUP BY symbol),
    f AS (SELECT e.symbol, e.bar, b.open, b.high, b.low, b.volume, b.trades, last_value(b.close IGNORE NULLS) OVER (PARTITION BY e.symbol ORDER BY e.bar) AS close FROM e LEFT JOIN bars AS b ON b.symbol = e.symbol AND b.bar = e.bar)
    SELECT symbol, bar, coalesce(open, close) AS open, coalesce(high, close) AS high, coalesce(low, close) AS low, close, coalesce(volume, 0) AS volume, coalesce(trades, 0) AS trades FROM f""", "ticks bars")  # fmt: skip
def filled_bars(v):
    return panel.fill_buckets(v.bars)
