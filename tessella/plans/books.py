"""Queries: walk-forward optimisation, tests of families, portfolio weights and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import allocation, search, signals

from .registry import query

_FAST = [10, 20, 40, 60]
_FOLDS = """(SELECT symbol, fold, fast, ins, out FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fold ORDER BY ins DESC, fast) AS nth FROM (
    SELECT symbol, fold, fast, avg(r) FILTER (stp < fold) / stddev_samp(r) FILTER (stp < fold) * sqrt(252) AS ins, avg(r) FILTER (stp = fold) / stddev_samp(r) FILTER (stp = fold) * sqrt(252) AS out
    FROM (SELECT *, i // (n // 6) AS stp FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fast ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY symbol, fast) AS n FROM gsim)), range(1, 6) t(fold) WHERE stp <= fold GROUP BY 1, 2, 3)) WHERE nth = 1)"""


@query("symbol", "fold fast", "is_sharpe oos_sharpe", f"SELECT symbol, fold, fast, ins AS is_sharpe, out AS oos_sharpe FROM {_FOLDS}", "px pr grid gsim", places=6)
def walk_forward_search(v):
    return search.walk_forward(search.grid_returns(v.px, _FAST), "fast", ["symbol"])


@query("symbol", "folds positive", "is_mean oos_mean degradation stability", f"""SELECT symbol, count(*) AS folds, count(*) FILTER (out > 0) AS positive, avg(ins) AS is_mean, avg(out) AS oos_mean, avg(ins) - avg(out) AS degradation, max(c) / count(*) AS stability
    FROM (SELECT *, count(*) OVER (PARTITION BY symbol, fast) AS c FROM {_FOLDS}) GROUP BY 1""", "px pr grid gsim", places=6)  # fmt: skip
def walk_forward_stability(v):
    return search.walk_forward_summary(search.walk_forward(search.grid_returns(v.px, _FAST), "fast", ["symbol"]), "fast", ["symbol"])


@query("run_id decision", "n", "posterior low high p_above", None)
def posterior_sharpe(v):
    return search.posterior_sharpe(v.rets)


_REGIMES = """m AS (SELECT dt, avg(ret) AS r FROM pr GROUP BY 1), vol AS (SELECT dt, CASE WHEN count(r) OVER w >= 21 THEN stddev_samp(r) OVER w END AS vol FROM m WINDOW w AS (ORDER BY dt ROWS BETWEEN 20 PRECEDING AND CURRENT ROW)),
    reg AS (SELECT dt, CASE WHEN vol <= lo THEN 'low' WHEN vol <= hi THEN 'mid' ELSE 'high' END AS regime FROM vol CROSS JOIN (SELECT quantile_cont(vol, 1 / 3e0) AS lo, quantile_cont(vol, 2 / 3e0) AS hi FROM vol) WHERE vol IS NOT NULL)"""


@query("symbol regime skipped", "fast n n_train n_out consensus votes", "coverage is_sharpe oos_sharpe", f"""WITH {_REGIMES}, d AS (SELECT *, row_number() OVER (PARTITION BY symbol, regime, fast ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY symbol, regime, fast) AS n FROM gsim JOIN reg USING (dt)),
    s AS (SELECT symbol, regime, fast, any_value(n) AS n, CAST(round_even(any_value(n) * 0.7e0, 0) AS BIGINT) AS cut, coalesce(avg(r) FILTER (i < round_even(n * 0.7e0, 0)) / nullif(stddev_samp(r) FILTER (i < round_even(n * 0.7e0, 0)), 0), 0) * sqrt(252) AS ins,
      coalesce(avg(r) FILTER (i >= round_even(n * 0.7e0, 0)) / nullif(stddev_samp(r) FILTER (i >= round_even(n * 0.7e0, 0)), 0), 0) * sqrt(252) AS out FROM d GROUP BY 1, 2, 3),
    b AS (SELECT *, sum(n) OVER (PARTITION BY symbol) AS total, n < 60 OR n - cut < 30 AS skipped FROM (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY symbol, regime ORDER BY ins DESC, fast) = 1)),
    v AS (SELECT symbol, fast AS consensus, count(*) AS votes FROM b WHERE NOT skipped GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY count(*) DESC, min(regime)) = 1)
    SELECT symbol, regime, skipped, n, n / total AS coverage, CASE WHEN NOT skipped THEN fast END AS fast, CASE WHEN NOT skipped THEN ins END AS is_sharpe, CASE WHEN NOT skipped THEN out END AS oos_sharpe, CASE WHEN NOT skipped THEN cut END AS n_train, CASE WHEN NOT skipped THEN n - cut END AS n_out, consensus, votes
    FROM b LEFT JOIN v USING (symbol)""", "px pr grid gsim", places=6)  # fmt: skip
def best_by_regime(v):
    market = signals.regimes(v.pr.groupBy("dt").agg(F.avg("ret").alias("r")).withColumn("run_id", F.lit("m")), "run_id").where("regime is not null").select("dt", "regime")
    return search.best_by_regime(search.grid_returns(v.px, _FAST).join(market, "dt"), "fast", ["symbol"])


@query("symbol", "fold fast", "is_sharpe oos_sharpe", f"""SELECT symbol, fold, fast, ins AS is_sharpe, out AS oos_sharpe FROM (SELECT symbol, fold, fast, avg(r) FILTER (i < fold * stp) / stddev_samp(r) FILTER (i < fold * stp) * sqrt(252) AS ins, avg(r) FILTER (i >= fold * stp) / stddev_samp(r) FILTER (i >= fold * stp) * sqrt(252) AS out
    FROM (SELECT *, n // 6 AS stp FROM (SELECT *, row_number() OVER (PARTITION BY symbol, fast ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY symbol, fast) AS n FROM gsim)), range(1, 6) t(fold) WHERE i < (fold + 1) * stp AND NOT (i >= fold * stp - 300 AND i < fold * stp) GROUP BY 1, 2, 3
    HAVING count(*) FILTER (i < fold * stp) >= 20) QUALIFY row_number() OVER (PARTITION BY symbol, fold ORDER BY ins DESC, fast) = 1""", "px pr grid gsim", places=6)  # fmt: skip
def walk_forward_purged(v):
    """A purge longer than a step: the first fold has no sample left, the others reach further back."""
    return search.walk_forward(search.grid_returns(v.px, _FAST), "fast", ["symbol"], purge=300)


@query("method run_id", "", "w", None)
def portfolio_weights(v):
    return allocation.weights(v.rets)


@query("", "", "sum_vol book_vol ratio", """SELECT sum(CASE WHEN a = b THEN sqrt(c) / 3 END) AS sum_vol, sqrt(sum(c / 9)) AS book_vol, sum(CASE WHEN a = b THEN sqrt(c) / 3 END) / sqrt(sum(c / 9)) AS ratio
    FROM (SELECT x.run_id AS a, y.run_id AS b, covar_samp(x.r, y.r) AS c FROM rets x JOIN rets y ON x.dt = y.dt GROUP BY 1, 2)""", "rets")  # fmt: skip
def diversification_ratio(v):
    return allocation.diversification(v.rets, v.rets.select("run_id").distinct().withColumn("w", F.lit(1.0 / 3)))


@query("", "n", "wa wn wr sharpe", """SELECT count(*) AS n, wa, wn, wr, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM (SELECT i / 10 AS wa, j / 10 AS wn, (10 - i - j) / 10 AS wr, i / 10 * a + j / 10 * n + (10 - i - j) / 10 * f AS r FROM wide, range(0, 11) x(i), range(0, 11) y(j) WHERE i + j <= 10) GROUP BY wa, wn, wr""", "rets wide", places=6)
def weight_search(v):
    grid = allocation.weight_grid(v.rets.select("run_id"))
    one = lambda k: F.max(F.when(F.col("run_id") == k, F.col("w")))
    held = grid.groupBy("sample").agg(one("A").alias("wa"), one("N").alias("wn"), one("R").alias("wr"))
    return allocation.search_weights(v.rets, grid).join(held, "sample")


@query("", "sample names n", "sharpe", """SELECT sample, bit_count(sample) AS names, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM (
    SELECT sample, dt, sum(r) / count(*) AS r FROM (SELECT *, dense_rank() OVER (ORDER BY symbol) - 1 AS bit, count(*) OVER (PARTITION BY dt) AS here FROM (SELECT symbol, dt, ret AS r FROM pr WHERE ret IS NOT NULL)), range(1, 32) t(sample) WHERE here = 5 AND (CAST(sample AS INT) >> CAST(bit AS INT)) % 2 = 1 GROUP BY 1, 2) GROUP BY 1, 2""", "px pr", places=6)  # fmt: skip
def subset_search(v):
    return allocation.search_subsets(v.pr.where("ret is not null").select(F.col("symbol").alias("run_id"), "dt", F.col("ret").alias("r")))


@query("run_id", "", "kelly shrunk", """WITH m AS (SELECT count(*) AS t, avg(a.r) AS ma, avg(n.r) AS mn, var_samp(a.r) AS aa, var_samp(n.r) AS nn, covar_samp(a.r, n.r) AS an FROM (SELECT * FROM rets WHERE run_id = 'A') AS a JOIN (SELECT * FROM rets WHERE run_id = 'N') AS n USING (dt)),
    f AS (SELECT *, (nn * ma - an * mn) / (aa * nn - an * an) AS fa, (aa * mn - an * ma) / (aa * nn - an * an) AS fn FROM m), g AS (SELECT *, ma * fa + mn * fn AS p FROM f)
    SELECT 'A' AS run_id, fa AS kelly, CASE WHEN p > 0 THEN fa * t * p / (t * p + 4) ELSE 0 END AS shrunk FROM g UNION ALL SELECT 'N', fn, CASE WHEN p > 0 THEN fn * t * p / (t * p + 4) ELSE 0 END FROM g""", "rets", places=5)  # fmt: skip
def multi_kelly(v):
    return allocation.multi_kelly(v.rets.where("run_id in ('A', 'N')").withColumn("family", F.lit("all")), "family")
