"""Queries: badges, crowding, survival, composite scores, floors, numbers as text, counts and period ends."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.functions import text
from tessella.operators import panel, scores, search, simulate

from .lifecycle import _FAST, _cpcv
from .registry import query

_CAST = """SELECT c_custkey AS id, CASE WHEN c_custkey % 5 <> 0 THEN (c_custkey % 11) / 10e0 END AS pbo, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 13) / 12e0 END AS psr, CASE WHEN c_custkey % 3 <> 0 THEN (c_custkey % 17) / 10e0 - 0.8e0 END AS edge_decay_slope,
    CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal / 5000e0 END AS crash_ratio, CASE WHEN c_custkey % 9 <> 0 THEN (c_custkey % 101) * 1e0 END AS crowding_score, CASE c_mktsegment WHEN 'BUILDING' THEN 'DECLINE' WHEN 'MACHINERY' THEN 'MATURITY' WHEN 'FURNITURE' THEN 'OTHER' END AS phase,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'Momentum' WHEN 'MACHINERY' THEN 'Seasonality' END AS family, CASE WHEN c_custkey % 6 <> 0 THEN c_acctbal / 4000e0 END AS momentum, CASE WHEN c_custkey % 8 <> 0 THEN (c_custkey % 10) / 6e0 END AS value,
    CASE WHEN c_custkey % 5 <> 1 THEN c_acctbal * 50000e0 END AS capacity_usd, CASE WHEN c_custkey % 5 <> 2 THEN (c_custkey % 29) * 1e0 END AS annual_turnover FROM customer"""


def _cast(v):
    """One row of stated metrics per customer, with gaps."""
    k = F.col("c_custkey")
    some = lambda by, at, x: F.when(k % by != at, x)
    segment = lambda **names: F.try_element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("c_mktsegment"))
    bal = F.col("c_acctbal").cast("double")
    return v.table("customer").select(
        k.alias("id"), some(5, 0, k % 11 / 10).alias("pbo"), some(7, 0, k % 13 / 12).alias("psr"), some(3, 0, k % 17 / 10 - 0.8).alias("edge_decay_slope"), some(4, 0, bal / 5000).alias("crash_ratio"), some(9, 0, (k % 101).cast("double")).alias("crowding_score"),
        segment(BUILDING="DECLINE", MACHINERY="MATURITY", FURNITURE="OTHER").alias("phase"), segment(BUILDING="Momentum", MACHINERY="Seasonality").alias("family"),
        some(6, 0, bal / 4000).alias("momentum"), some(8, 0, k % 10 / 6).alias("value"), some(5, 1, bal * 50000).alias("capacity_usd"), some(5, 2, (k % 29).cast("double")).alias("annual_turnover"),
    )


@query("verdict", "id", "score", f"""SELECT *, CASE WHEN score >= 70 THEN 'HIGH' WHEN score >= 45 THEN 'MODERATE' ELSE 'LOW' END AS verdict FROM (SELECT id, 100 * (0.45e0 * least(1, coalesce(greatest(abs(momentum), abs(value)) / 1.5e0, 0)) + 0.3e0 * CASE family WHEN 'Momentum' THEN 0.85e0 WHEN 'Seasonality' THEN 0.4e0 ELSE 0.5e0 END
    + 0.25e0 * CASE WHEN capacity_usd IS NULL THEN 0.5e0 ELSE least(1, log10(greatest(capacity_usd, 1e6) / 1e6) / 3) END * CASE WHEN annual_turnover > 0 THEN greatest(0, least(1, 1 - (annual_turnover - 2) / 20)) ELSE 1 END) AS score FROM ({_CAST}))""", places=6)  # fmt: skip
def crowding_score(v):
    return scores.crowding(_cast(v))


_PARTS = {"not_overfit": "a", "significant": "b", "not_decaying": "c", "crisis_robust": "d", "uncrowded": "e", "lifecycle": "f"}


@query("verdict weakest_link", "id", "probability", f"""SELECT *, CASE WHEN probability IS NULL THEN 'INSUFFICIENT_DATA' WHEN probability >= 0.65 THEN 'LIKELY_DURABLE' WHEN probability >= 0.45 THEN 'UNCERTAIN' ELSE 'AT_RISK' END AS verdict FROM (
    SELECT id, exp(list_avg([ln(greatest(0.05e0, x)) FOR x IN [a, b, c, d, e, f] IF x IS NOT NULL])) AS probability, CASE {" ".join(f"WHEN {k} = least(a, b, c, d, e, f) THEN '{n}'" for n, k in _PARTS.items())} END AS weakest_link FROM (
    SELECT id, 1 - pbo AS a, psr AS b, CASE WHEN edge_decay_slope IS NOT NULL THEN greatest(0, least(1, (edge_decay_slope + 0.5e0) / 0.7e0)) END AS c, CASE WHEN crash_ratio IS NOT NULL THEN greatest(0, least(1, crash_ratio)) END AS d, CASE WHEN crowding_score IS NOT NULL THEN 1 - crowding_score / 100 END AS e, CASE phase WHEN 'DECLINE' THEN 0.25e0 WHEN 'MATURITY' THEN 0.7e0 WHEN 'OTHER' THEN 0.5e0 END AS f FROM ({_CAST})))""", places=6)  # fmt: skip
def survival_score(v):
    return scores.survival(_cast(v))


_GRADED = f"""SELECT symbol, pbo, full_sharpe, max_drawdown, consistency, oos_sharpe FROM (SELECT symbol, pbo FROM ({_cpcv(0, 0)})) JOIN (
    SELECT symbol, avg(r) / stddev_samp(r) * sqrt(252) AS full_sharpe, avg(r) FILTER (i > 0.6e0 * n) / stddev_samp(r) FILTER (i > 0.6e0 * n) * sqrt(252) AS oos_sharpe FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS i, count(*) OVER (PARTITION BY symbol) AS n FROM gsim WHERE fast = 20) GROUP BY 1) USING (symbol) JOIN (
    SELECT symbol, min(le - top) AS lowest, exp(min(le - top)) - 1 AS max_drawdown FROM (SELECT *, max(le) OVER (PARTITION BY symbol ORDER BY dt) AS top FROM (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY dt) AS le FROM gsim WHERE fast = 20)) GROUP BY 1) USING (symbol) JOIN (
    SELECT symbol, avg(CAST(s > 0 AS DOUBLE)) AS consistency FROM (SELECT symbol, year(dt) AS y, avg(r) / nullif(stddev_samp(r), 0) AS s FROM gsim WHERE fast = 20 GROUP BY 1, 2) GROUP BY 1) USING (symbol)"""


def _graded(v):
    g = search.grid_returns(v.px, _FAST)
    one = g.where("fast = 20").withColumn("i", F.row_number().over(panel.along("symbol")))
    n = one.groupBy("symbol").agg(F.count("*").alias("n"))
    years = one.groupBy("symbol", F.year("dt").alias("y")).agg(F.try_divide(F.avg("r"), F.stddev_samp("r")).alias("s")).groupBy("symbol").agg(F.avg((F.col("s") > 0).cast("double")).alias("consistency"))
    late = one.join(n, "symbol").groupBy("symbol").agg(m.sharpe("r").alias("full_sharpe"), m.sharpe(F.when(F.col("i") > 0.6 * F.col("n"), F.col("r"))).alias("oos_sharpe"))
    deep = simulate.equity(one, "symbol").groupBy("symbol").agg(F.min("drawdown").alias("max_drawdown"))
    return search.cpcv_pbo(g, "fast", ["symbol"]).select("symbol", "pbo").join(late, "symbol").join(deep, "symbol").join(years, "symbol")


@query("symbol badge", "rank", "pbo", f"""SELECT *, CASE rank WHEN 0 THEN 'WEAK' WHEN 1 THEN 'FRAGILE' WHEN 2 THEN 'MODERATE' ELSE 'ROBUST' END AS badge FROM (SELECT *, least(CAST(pbo <= 0.5 AND full_sharpe >= 0.5 AS INT) + CAST(consistency >= 0.6 AS INT) + CAST(oos_sharpe >= 0.7 AS INT),
    CASE WHEN full_sharpe < 0.3 OR max_drawdown < -0.8 OR consistency < 0.4 THEN 1 WHEN full_sharpe < 0.5 OR max_drawdown < -0.6 THEN 2 ELSE 3 END) AS rank FROM ({_GRADED}))""", "px pr grid gsim", places=6)  # fmt: skip
def strategy_badge(v):
    return scores.badge(_graded(v))


@query("symbol reasons", "", "full_sharpe pbo", f"SELECT *, array_to_string(list_filter([CASE WHEN full_sharpe < 0.5 THEN 'full_sharpe' END, CASE WHEN oos_sharpe < 0.7 THEN 'oos_sharpe' END, CASE WHEN pbo > 0.3 THEN 'pbo' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ({_GRADED})", "px pr grid gsim", places=6)
def candidate_floors(v):
    d = scores.floors(_graded(v), {"full_sharpe": 0.5, "oos_sharpe": 0.7}, {"pbo": 0.3})
    return d.withColumn("reasons", F.array_join("reasons", ","))


_UPI = """SELECT {key}, g, sortino, trades, ulcer, deep, g / (ulcer / 100) AS upi, g / abs(deep) AS calmar FROM (SELECT {key}, exp(sum(ln(1 + r)) * 252 / count(r)) - 1 AS g, avg(r) / sqrt(avg(pow(least(r, 0), 2))) * sqrt(252) AS sortino, count(*) FILTER (r <> 0) AS trades FROM {source} GROUP BY ALL) JOIN (
    SELECT {key}, sqrt(avg(pow(100 * u, 2))) AS ulcer, min(u) AS deep FROM (SELECT *, exp(le - max(le) OVER (PARTITION BY {key} ORDER BY dt)) - 1 AS u FROM (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY {key} ORDER BY dt) AS le FROM {source})) GROUP BY ALL) USING ({key})"""


def _ulcer(returns, keys):
    d = simulate.equity(returns, keys).groupBy(*keys).agg(F.sqrt(F.avg(F.pow(100 * F.col("drawdown"), 2))).alias("ulcer"), F.count_if(F.col("r") != 0).alias("trades"))
    return simulate.core_metrics(returns, keys).join(d, keys).withColumn("upi", F.coalesce(F.try_divide(F.col("cagr"), F.col("ulcer") / 100), F.lit(0.0)))


@query("run_id upi_text growth_text", "", "upi ulcer", f"""SELECT *, printf('%.2f', upi) AS upi_text, printf('%.1f%%', 100 * g) AS growth_text FROM ({_UPI.format(key="run_id", source="rets")})""", "rets", places=6)
def ulcer_performance(v):
    return _ulcer(v.rets, ["run_id"]).withColumn("upi_text", text.number("upi")).withColumn("growth_text", text.percent("cagr", 1))


_TEN = "greatest(0, least(10, {}))"


@query("symbol", "fast trades", "composite", f"""SELECT *, exp((3 * ln(5.1e0) + ln(0.1e0 + {_TEN.format("upi / 5 * 10")}) + 2 * ln(5.1e0) + ln(0.1e0 + {_TEN.format("(sortino + 1) / 6 * 10")}) + ln(0.1e0 + sqrt(greatest(0, least(2, calmar)) / 2) * 10) + 1.2e0 * ln(0.1e0 + {_TEN.format("log10(1 + trades) / log10(10001e0) * 10")})
    + 1.5e0 * ln(0.1e0 + {_TEN.format("g / 0.2e0 * 10")}) + ln(0.1e0 + 10 / 3e0)) / 11.7e0) AS composite FROM ({_UPI.format(key="symbol, fast", source="gsim")})""", "px pr grid gsim", places=6)  # fmt: skip
def composite_scores(v):
    """Stability, consistency, recency and the probabilistic Sharpe are left unknown here."""
    return scores.composite(_ulcer(search.grid_returns(v.px, _FAST), ["symbol", "fast"]))


@query("symbol side", "n", "share", "SELECT symbol, side, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS share FROM ticks GROUP BY 1, 2", "ticks")
def side_counts(v):
    return panel.value_counts(v.ticks, ["symbol"], "side")


@query("symbol period dt", "", "price", "SELECT symbol, CAST(date_trunc('quarter', dt) AS DATE) AS period, max(dt) AS dt, arg_max(price, dt) AS price FROM px GROUP BY 1, 2", "px", places=6)
def quarter_ends(v):
    return panel.period_ends(v.px, "quarter")


@query("symbol period dt", "", "price", "SELECT symbol, CAST(date_trunc('week', dt) AS DATE) AS period, max(dt) AS dt, arg_max(price, dt) AS price FROM px GROUP BY 1, 2", "px", places=6)
def week_ends(v):
    return panel.period_ends(v.px, "week")


@query("dt", "", "", "SELECT DISTINCT dt FROM rets WHERE dt NOT IN (SELECT dt FROM px)", "rets px")
def dates_without_prices(v):
    return panel.missing_dates(v.rets, v.px)
