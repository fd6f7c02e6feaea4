"""Queries: search, overfit statistics, factors, portfolio."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.operators import panel, portfolio, search, simulate, validation

from .registry import query

_FAST = [10, 20, 40, 60]


@query("symbol", "fast", "sharpe", """SELECT symbol, fast, sharpe FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, fast) AS k FROM (SELECT symbol, fast, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM gsim GROUP BY 1, 2)) WHERE k = 1""", "px pr grid gsim", places=6)
def best_parameter(v):
    return search.best_combo(search.grid_returns(v.px, _FAST), "fast", ["symbol"])


@query("family", "test", "p bonferroni holm bh", """SELECT family, test, p, least(1, p * n) AS bonferroni, least(1, max(p * (n - k + 1)) OVER (PARTITION BY family ORDER BY p, test)) AS holm, least(1, min(p * n / rk) OVER (PARTITION BY family ORDER BY p DESC, test DESC ROWS UNBOUNDED PRECEDING)) AS bh FROM (
    SELECT *, count(*) OVER (PARTITION BY family) AS n, row_number() OVER (PARTITION BY family ORDER BY p, test) AS k, count(*) OVER (PARTITION BY family ORDER BY p) AS rk FROM (SELECT o_orderpriority AS family, o_custkey AS test, round((round(sum(o_totalprice), 2) % 1000) / 1000, 6) AS p FROM orders GROUP BY 1, 2))""")  # fmt: skip
def p_adjust(v):
    p = v.table("orders").groupBy(F.col("o_orderpriority").alias("family"), F.col("o_custkey").alias("test")).agg(F.round(F.round(F.sum("o_totalprice"), 2) % 1000 / 1000, 6).alias("p"))
    return validation.p_adjust(p)


@query("", "n", "alpha beta r2 up_capture down_capture beta_up beta_down", """SELECT count(*) AS n, regr_intercept(a, n) AS alpha, regr_slope(a, n) AS beta, regr_r2(a, n) AS r2,
    avg(a) FILTER (n > 0) / avg(n) FILTER (n > 0) AS up_capture, avg(a) FILTER (n < 0) / avg(n) FILTER (n < 0) AS down_capture,
    regr_slope(a, n) FILTER (n > 0) AS beta_up, regr_slope(a, n) FILTER (n < 0) AS beta_down FROM wide""", "rets wide", places=6)  # fmt: skip
def beta_capture(v):
    return portfolio.beta_capture(v.wide, "a", "n")


@query("dt", "", "beta corr", "SELECT dt, CASE WHEN count(*) OVER w >= 63 THEN covar_samp(a, n) OVER w / var_samp(n) OVER w END AS beta, CASE WHEN count(*) OVER w >= 63 THEN corr(a, n) OVER w END AS corr FROM wide WINDOW w AS (ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)", "rets wide", places=6)
def rolling_beta(v):
    # one pair of runs is one ordered sequence; many pairs would be partitioned by the pair
    w = Window.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(-62, 0)
    full = F.count("*").over(w) >= 63
    d = v.wide
    return d.select("dt", F.when(full, F.covar_samp("a", "n").over(w) / F.var_samp("n").over(w)).alias("beta"), F.when(full, F.corr("a", "n").over(w)).alias("corr"))


@query("a_id b_id", "n", "corr", "SELECT a.run_id AS a_id, b.run_id AS b_id, count(*) AS n, corr(a.r, b.r) AS corr FROM rets a JOIN rets b ON a.dt = b.dt AND a.run_id < b.run_id GROUP BY 1, 2", "rets")
def corr_pairs(v):
    return portfolio.pair_correlations(v.rets)


@query("run_id", "", "w", "SELECT run_id, (1 / sd) / sum(1 / sd) OVER () AS w FROM (SELECT run_id, stddev_samp(r) AS sd FROM rets GROUP BY 1)", "rets")
def inverse_vol(v):
    return portfolio.inverse_vol(v.rets)


@query("", "n", "hhi effective", "SELECT count(*) AS n, sum(w * w) AS hhi, 1 / sum(w * w) AS effective FROM (SELECT v / sum(v) OVER () AS w FROM (SELECT o_custkey, sum(o_totalprice) AS v FROM orders GROUP BY 1))")
def concentration(v):
    held = v.table("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    return portfolio.concentration(held, "v")


@query("run_id", "", "contribution share", """SELECT run_id, w * s / sqrt(tot) AS contribution, w * s / tot AS share FROM (SELECT a AS run_id, any_value(wa) AS w, sum(wb * c) AS s, sum(sum(wa * wb * c)) OVER () AS tot FROM (
    SELECT x.run_id AS a, y.run_id AS b, 1.0 / 3 AS wa, 1.0 / 3 AS wb, covar_samp(x.r, y.r) AS c FROM rets x JOIN rets y ON x.dt = y.dt GROUP BY 1, 2) GROUP BY a)""", "rets", places=10)  # fmt: skip
def euler_risk(v):
    w = v.rets.select("run_id").distinct().withColumn("w", F.lit(1.0 / 3))
    return portfolio.euler_risk(v.rets, w)


@query("dt", "active", "r", "SELECT dt, count(*) AS active, avg(r) AS r FROM rets GROUP BY dt", "rets", places=12)
def active_share_backtest(v):
    w = v.rets.select("run_id").distinct().withColumn("w", F.lit(1.0 / 3))
    return portfolio.active_share(v.rets, w)


@query("run_id", "", "ljung_box variance_ratio durbin_watson acf1", """SELECT run_id, n * (n + 2) * sum(acf * acf / (n - k)) AS ljung_box, any_value(vr) AS variance_ratio, any_value(dw) AS durbin_watson, max(acf) FILTER (k = 1) AS acf1 FROM (
    SELECT run_id, k, any_value(n) AS n, sum(d * e) / any_value(ss) AS acf FROM (SELECT run_id, k, d, n, ss, lag(d, k) OVER (PARTITION BY run_id, k ORDER BY dt) AS e FROM (SELECT *, sum(d * d) OVER (PARTITION BY run_id) AS ss FROM (SELECT run_id, dt, r - avg(r) OVER (PARTITION BY run_id) AS d, count(*) OVER (PARTITION BY run_id) AS n FROM rets)), range(1, 6) t(k)) GROUP BY 1, 2)
    JOIN (SELECT run_id, var_samp(r5) / (5 * var_samp(r)) AS vr, sum(pow(r - pr, 2)) / sum(r * r) AS dw FROM (SELECT *, CASE WHEN count(r) OVER w = 5 THEN sum(r) OVER w END AS r5, lag(r) OVER (PARTITION BY run_id ORDER BY dt) AS pr FROM rets WINDOW w AS (PARTITION BY run_id ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) GROUP BY 1) USING (run_id) GROUP BY run_id, n""", "rets", places=6)  # fmt: skip
def serial_tests(v):
    return portfolio.serial_tests(v.rets)


@query("a_seg o_priority", "n", "total", "SELECT coalesce(c_mktsegment, 'all') AS a_seg, coalesce(o_orderpriority, 'all') AS o_priority, count(*) AS n, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderpriority)", places=2)
def exposure_rollup(v):
    j = v.table("orders").join(v.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.rollup("c_mktsegment", "o_orderpriority").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).select(F.coalesce("c_mktsegment", F.lit("all")).alias("a_seg"), F.coalesce("o_orderpriority", F.lit("all")).alias("o_priority"), "n", "total")


@query("run_id name", "n", "total sharpe", """SELECT run_id, name, count(*) AS n, exp(sum(ln(1 + r))) - 1 AS total, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM rets JOIN (VALUES ('first', DATE '1996-01-01', DATE '1996-06-30'), ('second', DATE '1998-08-01', DATE '1998-10-31')) w(name, a, b) ON dt BETWEEN a AND b GROUP BY 1, 2""", "rets", places=6)
def crisis_windows(v):
    w = v.spark.createDataFrame([("first", "1996-01-01", "1996-06-30"), ("second", "1998-08-01", "1998-10-31")], "name string, a string, b string")
    w = w.select("name", F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    d = v.rets.join(F.broadcast(w), F.col("dt").between(F.col("a"), F.col("b")))  # the list of windows is fixed
    return d.groupBy("run_id", "name").agg(F.count("*").alias("n"), F.expm1(F.sum(F.log1p("r"))).alias("total"), m.sharpe("r").alias("sharpe"))
