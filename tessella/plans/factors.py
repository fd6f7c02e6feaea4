"""Queries: regressions, exposures, crises, grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import metrics
from tessella.operators import grid, inference, optimise, regression, search

from .inference import chi2
from .registry import query
from .views import CTES


def _pair(y: str, x1: str, x2: str, source: str, by: str = "") -> str:
    """Coefficients of y on two columns from covariances."""
    return f"""SELECT *, my - b1 * m1 - b2 * m2 AS b0, (b1 * s1y + b2 * s2y) / syy AS r2 FROM (SELECT *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) AS b1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) AS b2 FROM (
        SELECT {by}count(*) AS n, avg({y}) AS my, avg({x1}) AS m1, avg({x2}) AS m2, var_samp({y}) AS syy, var_samp({x1}) AS s11, var_samp({x2}) AS s22, covar_samp({x1}, {x2}) AS s12, covar_samp({x1}, {y}) AS s1y, covar_samp({x2}, {y}) AS s2y FROM {source}{" GROUP BY 1" if by else ""}))"""


@query("term", "n", "coef r2", f"WITH p AS ({_pair('a', 'n', 'f', 'wide')}) SELECT 'const' AS term, n, b0 AS coef, r2 FROM p UNION ALL SELECT 'n', n, b1, r2 FROM p UNION ALL SELECT 'f', n, b2, r2 FROM p", "rets wide", places=6)
def factor_regression(v):
    return regression.terms(regression.ols(v.wide.withColumn("book", F.lit("a")), "book", "a", ["n", "f"], lags=5), "book")


@query("term", "", "vif", """SELECT term, 1 / (1 - r2) AS vif FROM (SELECT 'a' AS term, r2 FROM (A) UNION ALL SELECT 'n', r2 FROM (N) UNION ALL SELECT 'f', r2 FROM (R))""".replace("(A)", f"({_pair('a', 'n', 'f', 'wide')})").replace("(N)", f"({_pair('n', 'a', 'f', 'wide')})").replace("(R)", f"({_pair('f', 'a', 'n', 'wide')})"), "rets wide", places=6)
def variance_inflation(v):
    return regression.vif(v.wide, ["a", "n", "f"])


_LONG = "(SELECT 'A' AS run_id, a AS r, n AS b, n * n AS q FROM wide UNION ALL SELECT 'R', f, n, n * n FROM wide)"


def _against(v):
    return v.wide.select("dt", F.col("n").alias("b"), F.inline(F.array(F.struct(F.lit("A").alias("run_id"), F.col("a").alias("r")), F.struct(F.lit("R").alias("run_id"), F.col("f").alias("r")))))


@query("run_id exposure", "", "gamma t", f"""SELECT run_id, b2 AS gamma, t, CASE WHEN n >= 50 AND abs(t) > 1.96 THEN CASE WHEN b2 > 0 THEN 'long_gamma' ELSE 'short_gamma' END ELSE 'neutral' END AS exposure FROM (
    SELECT *, b2 / sqrt((1 - r2) * syy * (n - 1) / (n - 3) * s11 / ((s11 * s22 - s12 * s12) * (n - 1))) AS t FROM ({_pair('r', 'b', 'q', _LONG, 'run_id, ')}))""", "rets wide", places=5)  # fmt: skip
def gamma_exposure(v):
    return regression.gamma_exposure(_against(v), "run_id", "r", "b")


_CASES = " ".join(f"WHEN '{g}/{t}' THEN '{p}'" for (g, t), p in regression.PAYOFFS.items())


@query("run_id payoff", "", "confidence", f"""SELECT run_id, CASE g || '/' || th {_CASES} ELSE 'unclassified' END AS payoff, least(1, abs(t) / 3) AS confidence FROM (SELECT run_id, t, CASE WHEN n >= 50 AND abs(t) > 1.96 THEN CASE WHEN b2 > 0 THEN 'long_gamma' ELSE 'short_gamma' END ELSE 'neutral' END AS g FROM (
    SELECT *, b2 / sqrt((1 - r2) * syy * (n - 1) / (n - 3) * s11 / ((s11 * s22 - s12 * s12) * (n - 1))) AS t FROM ({_pair('r', 'b', 'q', _LONG, 'run_id, ')}))) JOIN (
    SELECT run_id, CASE WHEN n < 50 THEN 'neutral' WHEN win > 0.55 AND abs(ac) < 0.1 THEN 'positive_theta' WHEN win < 0.45 AND ac > 0 THEN 'negative_theta' ELSE 'neutral' END AS th FROM (SELECT run_id, count(*) AS n, avg(CAST(r > 0 AS DOUBLE)) AS win, corr(r, l) AS ac FROM (
    SELECT run_id, r, lag(r) OVER (PARTITION BY run_id ORDER BY dt) AS l FROM (SELECT 'A' AS run_id, dt, a AS r FROM wide UNION ALL SELECT 'R', dt, f FROM wide)) GROUP BY 1)) USING (run_id)""", "rets wide", places=5)  # fmt: skip
def payoff_type(v):
    d = _against(v)
    return regression.payoff(regression.gamma_exposure(d, "run_id", "r", "b"), inference.theta_exposure(d), "run_id")


def _arch(lags: int) -> str:
    """R squared as the sum of squared correlations with the lags, each less what the lags before it explain."""
    out = f"WITH y AS (SELECT run_id, dt, pow(r - avg(r) OVER (PARTITION BY run_id), 2) AS y FROM rets), l AS (SELECT run_id, y, {', '.join(f'lag(y, {k}) OVER w AS l{k}' for k in range(1, lags + 1))} FROM y WINDOW w AS (PARTITION BY run_id ORDER BY dt)), g0 AS (SELECT * FROM l WHERE l{lags} IS NOT NULL)"
    for k in range(1, lags + 1):
        less = "".join(f" - regr_slope(l{k}, e{j}) OVER w * e{j}" for j in range(1, k))
        out += f", g{k} AS (SELECT *, l{k}{less} AS e{k} FROM g{k - 1} WINDOW w AS (PARTITION BY run_id))"
    return out + f", r AS (SELECT run_id, count(*) * ({' + '.join(f'pow(corr(y, e{k}), 2)' for k in range(1, lags + 1))}) AS lm FROM g{lags} GROUP BY 1) SELECT run_id, lm, {chi2('lm', lags)} AS p_value FROM r"


@query("run_id", "", "lm p_value", _arch(5), "rets", places=6)
def arch_effects(v):
    return regression.arch_test(v.rets)


@query("run_id verdict", "windows", "whole crisis ratio", """SELECT *, CASE WHEN ratio IS NULL THEN 'INSUFFICIENT_DATA' WHEN full_s <= 0 THEN 'NEGATIVE_EDGE' WHEN ratio > 1.5 THEN 'CONVEXITY_CANDIDATE' WHEN ratio >= 0.7 THEN 'ROBUST_TO_CRISES' WHEN ratio >= 0.3 THEN 'MIXED' ELSE 'VOL_RISK_PREMIUM_CANDIDATE' END AS verdict, full_s AS "full" FROM (
    SELECT run_id, full_s, avg(s) AS crisis, count(s) AS windows, avg(s) / full_s AS ratio FROM (SELECT run_id, avg(r) / stddev_samp(r) * sqrt(252) AS full_s FROM rets GROUP BY 1) LEFT JOIN (
    SELECT run_id, year(dt) AS y, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM rets WHERE month(dt) IN (2, 3) GROUP BY 1, 2 HAVING count(*) >= 5) USING (run_id) GROUP BY 1, 2)""".replace('"full"', "whole"), "rets", places=6)  # fmt: skip
def crisis_verdict(v):
    """The windows are February and March of every year."""
    years = v.rets.select(F.year("dt").alias("y")).distinct()
    windows = years.select(F.col("y").alias("label"), F.make_date("y", F.lit(2), F.lit(1)).alias("start_dt"), F.make_date("y", F.lit(3), F.lit(31)).alias("end_dt"))
    return regression.crisis_verdict(v.rets, windows)


@query("", "bucket rows", "market_mean mean", """SELECT bucket, count(*) AS rows, avg(n) AS market_mean, avg(a) AS mean FROM (SELECT a, n, CAST(n > q[1] AS INT) + CAST(n > q[2] AS INT) + CAST(n > q[3] AS INT) + CAST(n > q[4] AS INT) + CAST(n > q[5] AS INT) + CAST(n > q[6] AS INT) AS bucket FROM wide CROSS JOIN (
    SELECT [quantile_cont(n, 1 / 7e0), quantile_cont(n, 2 / 7e0), quantile_cont(n, 3 / 7e0), quantile_cont(n, 4 / 7e0), quantile_cont(n, 5 / 7e0), quantile_cont(n, 6 / 7e0)] AS q FROM wide)) GROUP BY 1""", "rets wide", places=6)  # fmt: skip
def market_buckets(v):
    return regression.market_buckets(v.wide, "a", "n", 7)


@query("strict", "groups", "rho spread", """SELECT count(*) AS groups, corr(a, b) AS rho, (arg_max(m, a) - arg_min(m, a)) * 252 AS spread, min(step) > 0 OR max(step) < 0 AS strict FROM (SELECT m, CAST(rank() OVER (ORDER BY bucket) AS DOUBLE) AS a, CAST(rank() OVER (ORDER BY m) AS DOUBLE) AS b, m - lag(m) OVER (ORDER BY bucket) AS step FROM (
    SELECT bucket, avg(fwd) AS m FROM (SELECT fwd, ntile(5) OVER (PARTITION BY symbol ORDER BY signal, dt) AS bucket FROM sig WHERE signal IS NOT NULL AND fwd IS NOT NULL) GROUP BY 1))""", "px pr sig", places=6)  # fmt: skip
def bucket_monotonicity(v):
    from pyspark.sql import Window

    d = v.sig.where("signal is not null and fwd is not null").withColumn("bucket", F.ntile(5).over(Window.partitionBy("symbol").orderBy("signal", "dt")))
    return regression.monotonicity(d, "fwd", "bucket")


_LENGTHS = list(range(5, 101, 5))
_THIN = [5, 20, 40, 60, 80, 100]


def _graded(lengths: list[int]) -> str:
    return f"WITH grid AS (SELECT unnest({lengths}) AS fast), gsim AS ({CTES['gsim']}) SELECT symbol, fast, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM gsim GROUP BY 1, 2"


@query("symbol", "fast n", "sharpe", _graded(_THIN), "px pr", places=6)
def parameter_grid(v):
    """Six of twenty lengths of the moving-average rule, simulated on the given prices."""
    thin = [r.fast for r in grid.lattice(v.spark, {"fast": _LENGTHS}, 6).orderBy("combo").collect()]
    return search.grid_returns(v.px, thin).groupBy("symbol", "fast").agg(F.count("*").alias("n"), metrics.sharpe("r").alias("sharpe"))


@query("symbol", "fast n", "sharpe", f"""WITH every AS ({_graded(_LENGTHS)}), best AS (SELECT symbol, fast AS top FROM every WHERE fast IN ({str(_THIN)[1:-1]}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, fast) = 1)
    SELECT every.* FROM every JOIN best USING (symbol) WHERE abs(fast - top) <= 10""", "px pr", places=6)  # fmt: skip
def refined_grid(v):
    """The lengths within two places of each symbol's best of the thinned grid, simulated."""
    every, thin = grid.lattice(v.spark, {"fast": _LENGTHS}), [r.fast for r in grid.lattice(v.spark, {"fast": _LENGTHS}, 6).collect()]
    best = search.best_combo(search.grid_returns(v.px, thin), "fast", ["symbol"])
    near = grid.neighbours(every, best, ["symbol"], 2).select("symbol", "fast")
    return search.grid_returns(v.px, _LENGTHS).join(near, ["symbol", "fast"]).groupBy("symbol", "fast").agg(F.count("*").alias("n"), metrics.sharpe("r").alias("sharpe"))


@query("symbol", "fast n", "sharpe", f"SELECT * FROM ({_graded(_LENGTHS)}) WHERE fast IN (5, 15, 30, 40, 55, 65, 80, 90)", "px pr", places=6)
def sampled_grid(v):
    """Eight of the twenty lengths, where Sobol's sequence falls, simulated."""
    some = [r.fast for r in grid.sampled(grid.lattice(v.spark, {"fast": _LENGTHS}), 8).collect()]
    return search.grid_returns(v.px, some).groupBy("symbol", "fast").agg(F.count("*").alias("n"), metrics.sharpe("r").alias("sharpe"))


def _lengths(prices, combos):
    return search.grid_returns(prices, sorted(r.fast for r in combos.select("fast").distinct().collect()))


@query("symbol verdict grade", "tried combo rejected wf_positive", "sharpe default_sharpe improvement pbo score reality_p able_p wf_is wf_oos wf_stability", None, places=6)
def optimise_lengths(v):
    """The length of the moving-average rule of every symbol, searched in two passes; tests hold each column against its own operator."""
    tried = optimise.two_pass(v.px, _lengths, {"fast": _LENGTHS}, "symbol", most=6, span=1)
    return optimise.report(tried, "symbol", default=3, purge=5, embargo=8, draws=60)
