"""Queries: simulation, metrics, drawdowns, risk."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.operators import panel, simulate

from .registry import query

_Z05 = NormalDist().inv_cdf(0.05)
_CORE = f"""SELECT run_id, count(r) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, stddev_samp(r) * sqrt(252) AS volatility,
    exp(sum(ln(1 + r)) * 252 / count(r)) - 1 AS cagr, avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) AS sortino,
    avg(CASE WHEN r <> 0 THEN CAST(r > 0 AS DOUBLE) END) AS win_rate, avg(r) AS expected_value,
    (avg(r*r*r) - 3*avg(r)*avg(r*r) + 2*pow(avg(r),3)) / pow(var_pop(r), 1.5) AS skewness, kurtosis_pop(r) AS kurtosis,
    avg(r) + {_Z05!r} * stddev_samp(r) AS gaussian_var, min(drawdown) AS max_drawdown,
    (exp(sum(ln(1 + r)) * 252 / count(r)) - 1) / abs(min(drawdown)) AS calmar FROM dd GROUP BY run_id"""


@query("run_id", "n", "sharpe volatility cagr sortino win_rate expected_value skewness kurtosis gaussian_var max_drawdown calmar", _CORE, "rets dd", places=6)
def core_metrics(v):
    return simulate.core_metrics(v.rets)


@query("symbol", "n", "sharpe cagr max_drawdown win_rate", """SELECT symbol, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, exp(sum(ln(1 + r)) * 252 / count(r)) - 1 AS cagr,
    min(exp(le - peak) - 1) AS max_drawdown, avg(CASE WHEN r <> 0 THEN CAST(r > 0 AS DOUBLE) END) AS win_rate
    FROM (SELECT *, max(le) OVER (PARTITION BY symbol ORDER BY dt) AS peak FROM (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY dt) AS le FROM gsim WHERE fast = 20)) GROUP BY symbol""", "px pr grid gsim", places=6)  # fmt: skip
def simulate_sma(v):
    w = simulate.sma_rule(v.px, 20).withColumn("run_id", F.col("symbol"))
    out = simulate.core_metrics(simulate.simulate_weights(w))
    return out.withColumnRenamed("run_id", "symbol")


@query("symbol", "fast n", "sharpe", "SELECT fast, symbol, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM gsim GROUP BY 1, 2", "px pr grid gsim", places=6)
def simulate_grid(v):
    from tessella.operators import search

    return search.grid_returns(v.px, [10, 20, 40, 60]).groupBy("fast", "symbol").agg(F.count("*").alias("n"), m.sharpe("r").alias("sharpe"))


@query("run_id dt", "", "log_equity drawdown", "SELECT run_id, dt, le AS log_equity, drawdown FROM dd", "rets dd")
def equity_curve(v):
    return simulate.equity(v.rets, "run_id")


@query("run_id start_dt end_dt", "episode bars", "depth", """SELECT run_id, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS bars, min(drawdown) AS depth, row_number() OVER (PARTITION BY run_id ORDER BY min(dt)) AS episode
    FROM (SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY dt) AS isl FROM (SELECT *, CASE WHEN (drawdown < 0) IS DISTINCT FROM lag(drawdown < 0) OVER (PARTITION BY run_id ORDER BY dt) THEN 1 ELSE 0 END AS c FROM dd))
    WHERE drawdown < 0 GROUP BY run_id, isl""", "rets dd")  # fmt: skip
def drawdown_episodes(v):
    return simulate.drawdown_episodes(v.rets, "run_id").withColumnsRenamed({"start": "start_dt", "end": "end_dt"})


@query("run_id", "under n", "share ulcer pain", "SELECT run_id, count(*) FILTER (drawdown < 0) AS under, count(*) AS n, avg(CAST(drawdown < 0 AS DOUBLE)) AS share, sqrt(avg(pow(100 * drawdown, 2))) AS ulcer, avg(abs(drawdown)) AS pain FROM dd GROUP BY run_id", "rets dd")
def underwater_summary(v):
    d = simulate.equity(v.rets, "run_id")
    return d.groupBy("run_id").agg(F.count_if(F.col("drawdown") < 0).alias("under"), F.count("*").alias("n"), F.avg((F.col("drawdown") < 0).cast("double")).alias("share"), F.sqrt(F.avg(F.pow(100 * F.col("drawdown"), 2))).alias("ulcer"), F.avg(F.abs("drawdown")).alias("pain"))


@query("run_id", "", "var95 cvar95 var99", """SELECT run_id, any_value(q) AS var95, avg(r) FILTER (r <= q) AS cvar95, any_value(q1) AS var99
    FROM rets JOIN (SELECT run_id, quantile_cont(r, 0.05) AS q, quantile_cont(r, 0.01) AS q1 FROM rets GROUP BY 1) USING (run_id) GROUP BY run_id""", "rets")  # fmt: skip
def var_cvar(v):
    from tessella.operators import risk

    return risk.var_cvar(v.rets)


@query("run_id", "", "omega gain_to_pain tail_ratio", """SELECT run_id, sum(greatest(r, 0)) / sum(greatest(-r, 0)) AS omega, sum(r) / abs(sum(least(r, 0))) AS gain_to_pain, quantile_cont(r, 0.95) / abs(quantile_cont(r, 0.05)) AS tail_ratio FROM rets GROUP BY 1""", "rets")
def omega_gain_tail(v):
    return v.rets.groupBy("run_id").agg(m.omega("r").alias("omega"), m.gain_to_pain("r").alias("gain_to_pain"), m.tail_ratio("r").alias("tail_ratio"))


@query("run_id", "", "rachev cdar", """SELECT a.run_id, rachev, cdar FROM
    (SELECT run_id, avg(r) FILTER (r >= hi) / abs(avg(r) FILTER (r <= lo)) AS rachev FROM rets JOIN (SELECT run_id, quantile_cont(r, 0.95) AS hi, quantile_cont(r, 0.05) AS lo FROM rets GROUP BY 1) USING (run_id) GROUP BY 1) a JOIN
    (SELECT run_id, avg(-drawdown) FILTER (-drawdown >= q) AS cdar FROM dd JOIN (SELECT run_id, quantile_cont(-drawdown, 0.95) AS q FROM dd GROUP BY 1) USING (run_id) GROUP BY 1) b USING (run_id)""", "rets dd")  # fmt: skip
def rachev_cdar(v):
    from tessella.operators import risk

    return risk.rachev(v.rets).join(risk.cdar(v.rets), "run_id")


@query("run_id", "", "sterling burke", """SELECT run_id, g / avg(abs(depth)) AS sterling, g / sqrt(avg(depth * depth)) AS burke FROM (
    SELECT run_id, min(drawdown) AS depth, row_number() OVER (PARTITION BY run_id ORDER BY min(drawdown), min(dt)) AS k
    FROM (SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY dt) AS isl FROM (SELECT *, CASE WHEN (drawdown < 0) IS DISTINCT FROM lag(drawdown < 0) OVER (PARTITION BY run_id ORDER BY dt) THEN 1 ELSE 0 END AS c FROM dd))
    WHERE drawdown < 0 GROUP BY run_id, isl) JOIN (SELECT run_id, exp(sum(ln(1 + r)) * 252 / count(r)) - 1 AS g FROM rets GROUP BY 1) USING (run_id) WHERE k <= 5 GROUP BY run_id, g""", "rets dd", places=6)  # fmt: skip
def sterling_burke(v):
    from tessella.operators import risk

    return risk.sterling_burke(v.rets)


@query("run_id", "", "cornish_fisher", f"""SELECT run_id, mu + sd * ({_Z05!r} + (z*z - 1) * g1 / 6 + (z*z*z - 3*z) * g2 / 24 - (2*z*z*z - 5*z) * g1 * g1 / 36) AS cornish_fisher FROM (
    SELECT run_id, avg(r) AS mu, stddev_samp(r) AS sd, skewness(r) AS g1, kurtosis(r) AS g2, CAST({_Z05!r} AS DOUBLE) AS z FROM rets GROUP BY 1)""", "rets")  # fmt: skip
def cornish_fisher_var(v):
    from tessella.operators import risk

    return risk.cornish_fisher(v.rets)


@query("run_id", "yr n", "sharpe compounded", "SELECT run_id, year(dt) AS yr, count(*) AS n, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS sharpe, exp(sum(ln(1 + r))) - 1 AS compounded FROM rets GROUP BY 1, 2", "rets", places=6)
def per_year(v):
    return v.rets.groupBy("run_id", F.year("dt").alias("yr")).agg(F.count("*").alias("n"), m.sharpe("r").alias("sharpe"), F.expm1(F.sum(F.log1p("r"))).alias("compounded"))


@query("run_id", "fold n", "sharpe", "SELECT run_id, fold, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM (SELECT *, ntile(8) OVER (PARTITION BY run_id ORDER BY dt) AS fold FROM rets) GROUP BY 1, 2", "rets", places=6)
def walk_forward_folds(v):
    from tessella.operators import validation

    return validation.folds(v.rets, 8)


@query("run_id verdict", "", "efficiency consistency cv", """SELECT run_id, avg(s) / any_value(full_s) AS efficiency, avg(CAST(s > 0 AS DOUBLE)) AS consistency, stddev_samp(s) / abs(avg(s)) AS cv,
    CASE WHEN stddev_samp(s) / abs(avg(s)) < 0.5 AND avg(CAST(s > 0 AS DOUBLE)) >= 0.7 THEN 'robust' WHEN stddev_samp(s) / abs(avg(s)) < 1 AND avg(CAST(s > 0 AS DOUBLE)) >= 0.5 THEN 'moderate' ELSE 'fragile' END AS verdict
    FROM (SELECT run_id, fold, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM (SELECT *, ntile(8) OVER (PARTITION BY run_id ORDER BY dt) AS fold FROM rets) GROUP BY 1, 2)
    JOIN (SELECT run_id, avg(r) / stddev_samp(r) * sqrt(252) AS full_s FROM rets GROUP BY 1) USING (run_id) GROUP BY run_id""", "rets", places=6)  # fmt: skip
def walk_forward_summary(v):
    from tessella.operators import validation

    return validation.fold_summary(v.rets, 8)


@query("run_id dt", "", "rolling_sharpe", """SELECT run_id, dt, CASE WHEN count(r) OVER w >= 63 THEN avg(r) OVER w / stddev_samp(r) OVER w * sqrt(252) END AS rolling_sharpe FROM rets
    WINDOW w AS (PARTITION BY run_id ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)""", "rets", places=6)  # fmt: skip
def rolling_sharpe(v):
    w = panel.along("run_id")
    r = F.col("r")
    return v.rets.withColumn("rolling_sharpe", panel.rolling(r, 63, w) / panel.rolling(r, 63, w, F.stddev_samp) * F.sqrt(F.lit(252.0)))


@query("run_id", "yr mon", "ret", "SELECT run_id, year(dt) AS yr, month(dt) AS mon, exp(sum(ln(1 + r))) - 1 AS ret FROM rets GROUP BY 1, 2, 3", "rets")
def monthly_table(v):
    return v.rets.groupBy("run_id", F.year("dt").alias("yr"), F.month("dt").alias("mon")).agg(F.expm1(F.sum(F.log1p("r"))).alias("ret"))


@query("run_id", "bin n", "", """SELECT run_id, bin, count(*) AS n FROM (SELECT run_id, least(floor((r - lo) / ((hi - lo) / 40)), 39) AS bin FROM rets JOIN (SELECT run_id, min(r) AS lo, max(r) AS hi FROM rets GROUP BY 1) USING (run_id)) GROUP BY 1, 2""", "rets")
def return_histogram(v):
    edge = Window.partitionBy("run_id")
    lo, hi = F.min("r").over(edge), F.max("r").over(edge)
    return v.rets.withColumn("bin", F.least(F.floor((F.col("r") - lo) / ((hi - lo) / 40)), F.lit(39))).groupBy("run_id", "bin").agg(F.count("*").alias("n"))


@query("run_id", "longest", "", """SELECT run_id, max(n) AS longest FROM (SELECT run_id, g, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dt) - row_number() OVER (PARTITION BY run_id, r > 0 ORDER BY dt) AS g FROM rets) WHERE r > 0 GROUP BY 1, 2) GROUP BY 1""", "rets")
def max_consecutive_wins(v):
    return panel.longest_run(v.rets, "run_id", F.col("r") > 0)


@query("run_id", "", "pezier_white newey_west", """SELECT p.run_id, pw AS pezier_white, nw AS newey_west FROM (
    SELECT run_id, avg(r)/stddev_samp(r) * (1 + sk/6 * avg(r)/stddev_samp(r) - kt/24 * pow(avg(r)/stddev_samp(r), 2)) * sqrt(252) AS pw FROM rets JOIN (SELECT run_id, (avg(r*r*r) - 3*avg(r)*avg(r*r) + 2*pow(avg(r),3)) / pow(var_pop(r), 1.5) AS sk, kurtosis_pop(r) AS kt FROM rets GROUP BY 1) USING (run_id) GROUP BY run_id, sk, kt) p JOIN (
    SELECT run_id, any_value(mu) / sqrt(sum(CASE WHEN k = 0 THEN c ELSE 2 * (1 - k / (lags + 1.0)) * c END)) * sqrt(252) AS nw FROM (
      SELECT a.run_id, a.k, any_value(a.lags) AS lags, any_value(a.mu) AS mu, sum(a.d * b.d) / any_value(a.n) AS c FROM (SELECT * FROM (SELECT *, least(greatest(floor(4 * pow(n / 100.0, 2.0 / 9)), 1), floor(n / 4)) AS lags FROM (SELECT run_id, r - avg(r) OVER (PARTITION BY run_id) AS d, avg(r) OVER (PARTITION BY run_id) AS mu, count(*) OVER (PARTITION BY run_id) AS n, row_number() OVER (PARTITION BY run_id ORDER BY dt) AS rn FROM rets)), range(0, 60) t(k) WHERE k <= lags) a
      JOIN (SELECT run_id, r - avg(r) OVER (PARTITION BY run_id) AS d, row_number() OVER (PARTITION BY run_id ORDER BY dt) AS rn FROM rets) b ON a.run_id = b.run_id AND b.rn = a.rn - a.k GROUP BY a.run_id, a.k) GROUP BY run_id) q USING (run_id)""", "rets", places=6)  # fmt: skip
def adjusted_sharpes(v):
    from tessella.operators import validation

    pw = v.rets.groupBy("run_id").agg(m.pezier_white("r").alias("pezier_white"))
    return pw.join(validation.newey_west_sharpe(v.rets), "run_id")
