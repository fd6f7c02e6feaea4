"""Queries: stationarity tests, tail fits, draws by uniqueness, parameter clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import clusters, diagnosis, hidden, search, simulate, stationarity, tail_fit, unique_draws

from .checks import UNIQUE
from .inference import chi2
from .registry import query
from .structure import _uniform

_SERIES = "SELECT run_id, dt, r FROM rets UNION ALL SELECT symbol, dt, price FROM px"


def _series(v):
    """The runs' returns, which are stationary, and the symbols' prices, which wander."""
    return v.rets.select("run_id", "dt", "r").unionByName(v.px.select(F.col("symbol").alias("run_id"), "dt", F.col("price").alias("r")))


@query("run_id stationary", "n lags", "statistic p_value", None)
def dickey_fuller(v):
    """SQL has no elimination of a matrix of some thirty columns; tests hold every nested regression against least squares."""
    return stationarity.dickey_fuller(_series(v))


_LEVEL = f"""WITH d AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY dt) AS i, count(*) OVER (PARTITION BY run_id) AS n, r - avg(r) OVER (PARTITION BY run_id) AS e FROM ({_SERIES})),
    c AS (SELECT a.run_id, a.n, b.i - a.i AS k, sum(a.e * b.e) AS c FROM d AS a JOIN d AS b ON a.run_id = b.run_id AND b.i - a.i BETWEEN 0 AND 150 GROUP BY 1, 2, 3),
    t AS (SELECT run_id, any_value(n) AS n, 2 * sum(k * c) FILTER (k > 0 AND k <= floor(pow(n, 2 / 9e0))) / (max(c) FILTER (k = 0) + 2 * sum(c) FILTER (k > 0 AND k <= floor(pow(n, 2 / 9e0)))) AS tilt FROM c GROUP BY 1),
    l AS (SELECT *, least(floor(1.1447e0 * pow(tilt * tilt, 1 / 3e0) * pow(n, 1 / 3e0)), n - 1) AS lags FROM t),
    v AS (SELECT run_id, any_value(c.n) AS n, any_value(lags) AS lags, sum(CASE WHEN k = 0 THEN c ELSE 2 * c * (1 - k / (lags + 1)) END) AS v FROM c JOIN l USING (run_id) WHERE k <= lags GROUP BY 1),
    s AS (SELECT run_id, sum(s * s) AS ss FROM (SELECT run_id, sum(e) OVER (PARTITION BY run_id ORDER BY i) AS s FROM d) GROUP BY 1),
    x AS (SELECT run_id, n, lags, ss / n / v AS statistic FROM v JOIN s USING (run_id))
    SELECT *, p_value > 0.05 AS stationary FROM (SELECT *, CASE WHEN statistic <= 0.347 THEN 0.1 WHEN statistic <= 0.463 THEN 0.1 - (statistic - 0.347) * 0.05 / 0.116 WHEN statistic <= 0.574 THEN 0.05 - (statistic - 0.463) * 0.025 / 0.111
      WHEN statistic <= 0.739 THEN 0.025 - (statistic - 0.574) * 0.015 / 0.165 ELSE 0.01 END AS p_value FROM x)"""


@query("run_id stationary", "n lags", "statistic p_value", _LEVEL, "rets px", places=6)
def level_stationarity(v):
    return stationarity.level_stationarity(_series(v))


@query("run_id drifts", "n", "statistic p_value", f"""SELECT *, {chi2('statistic', 2)} AS p_value, {chi2('statistic', 2)} < 0.05 AS drifts FROM (SELECT run_id, any_value(n) AS n, any_value(n) * (pow(corr(y, t), 2) + pow(corr(y, w), 2)) AS statistic FROM (
    SELECT *, u - regr_intercept(u, t) OVER o - regr_slope(u, t) OVER o * t AS w FROM (SELECT run_id, r * r AS y, CAST(i AS DOUBLE) AS t, pow(i, 2) AS u, n FROM (SELECT run_id, r, row_number() OVER (PARTITION BY run_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM ({_SERIES}))) WINDOW o AS (PARTITION BY run_id)) GROUP BY 1)""", "rets px", places=5)  # fmt: skip
def drifting_variance(v):
    return stationarity.drifting_variance(_series(v))


@query("run_id", "n exceedances", "threshold xi sigma var cvar", None, places=6)
def pareto_tail(v):
    """A maximum-likelihood fit; tests hold it to its score equations."""
    return tail_fit.pareto_tail(v.rets)


_RINGS = f"""SELECT symbol, draw, place, dt FROM (SELECT symbol, draw, dt, row_number() OVER (PARTITION BY symbol, draw ORDER BY t, dt) AS place, n FROM (
    SELECT symbol, draw, dt, n, sum(wait) OVER (PARTITION BY symbol, draw, dt ORDER BY j) AS t FROM (SELECT symbol, draw, dt, j, j * -ln({_uniform("'ring:' || draw || ':' || dt || ':' || j")}) / weight AS wait, n FROM (
    SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM ({UNIQUE})) CROSS JOIN (SELECT unnest([0, 1]) AS draw) CROSS JOIN (SELECT unnest(range(1, 33)) AS j)))) WHERE place <= n"""


@query("symbol dt", "draw place", "", _RINGS, "px pr")
def sequential_draws(v):
    labels = diagnosis.uniqueness(v.pr.where("abs(ret) > 0.005"), v.px)
    return unique_draws.sequential_bootstrap(labels, "symbol", "dt", "weight", draws=2)


@query("symbol", "cluster size", "mean_score best_score inertia fast", None, places=6)
def parameter_clusters(v):
    """Lengths of the moving-average rule, simulated on the given prices; k-means has no SQL, tests hold it against NumPy."""
    s = simulate.core_metrics(search.grid_returns(v.px, list(range(5, 101, 5))), ("symbol", "fast"))
    return clusters.parameter_clusters(s.select("symbol", "fast", "sharpe"), "symbol", "fast", ["fast"], "sharpe", top=0.5)


@query("run_id dt", "regime states", "log_likelihood bic", None, places=3)
def hidden_regimes(v):
    """Fitted by rounds that SQL cannot iterate at this length; tests hold rounds and paths against plain passes."""
    return hidden.hidden_regimes(v.rets, rounds=20)


@query("run_id", "bars labelled low refits", "", None)
def walked_regimes(v):
    d = hidden.walked_regimes(v.rets, rounds=10)
    return d.groupBy("run_id").agg(F.count("*").alias("bars"), F.count_if(F.col("regime") >= 0).alias("labelled"), F.count_if(F.col("regime") == 0).alias("low"), F.max("refits").alias("refits"))
