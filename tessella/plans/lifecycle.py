"""Queries: hold-outs, cross-validation, life cycle, labels, ledgers, costs, capacity, adjustment, calendars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.operators import allocation, diagnosis, inference, panel, search, signals, simulate, validation

from .inference import _gates, cdf
from .registry import query

_FAST = [10, 20, 40, 60]


def _sharpe(on: str) -> str:
    return f"coalesce(avg(r) FILTER ({on}) / nullif(stddev_samp(r) FILTER ({on}), 0), 0) * sqrt(252)"


@query("run_id degraded", "is_n oos_n hold_n", "is_sharpe oos_sharpe hold_sharpe", f"""SELECT *, hold_sharpe < 0 OR (oos_sharpe > 0 AND hold_sharpe < 0.3 * oos_sharpe) AS degraded FROM (SELECT run_id, {_sharpe("i < x")} AS is_sharpe, {_sharpe("i >= x AND i < y")} AS oos_sharpe, {_sharpe("i >= y")} AS hold_sharpe,
    count(*) FILTER (i < x) AS is_n, count(*) FILTER (i >= x AND i < y) AS oos_n, count(*) FILTER (i >= y) AS hold_n FROM (SELECT *, floor(n * 6e-1) AS x, floor(n * 8e-1) AS y FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM rets)) WHERE n > 50 GROUP BY 1)""", "rets", places=6)  # fmt: skip
def holdout(v):
    return search.holdout(v.rets)


def _splits(purge: int, embargo: int) -> str:
    """(symbol, fast, a, b, ins, out): Sharpes of every split with the test groups a and b, by flags on every bar."""
    inside = "NOT test AND NOT near"
    return f"""SELECT symbol, fast, a, b, coalesce(avg(r) FILTER ({inside}) / nullif(stddev_samp(r) FILTER ({inside}), 0), 0) * sqrt(252) AS ins, coalesce(avg(r) FILTER (test) / nullif(stddev_samp(r) FILTER (test), 0), 0) * sqrt(252) AS out FROM (
    SELECT *, (i >= la AND i < ha) OR (i >= lb AND i < hb) AS test, (i >= la - {purge} AND i < ha + {max(purge, embargo)}) OR (i >= lb - {purge} AND i < hb + {max(purge, embargo)}) AS near FROM (
    SELECT symbol, fast, r, i, a, b, (a * n) // 10 AS la, ((a + 1) * n) // 10 AS ha, (b * n) // 10 AS lb, ((b + 1) * n) // 10 AS hb FROM (
    SELECT *, row_number() OVER (PARTITION BY symbol, fast ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY symbol, fast) AS n FROM gsim) CROSS JOIN (SELECT x AS a, y AS b FROM (SELECT unnest(range(10)) AS x) CROSS JOIN (SELECT unnest(range(10)) AS y) WHERE x < y))) GROUP BY 1, 2, 3, 4
    HAVING count(*) FILTER ({inside}) >= 2"""


def _cpcv(purge: int, embargo: int) -> str:
    return f"""SELECT symbol, count(*) AS splits, avg(CAST(rk < 0.5 AS DOUBLE)) AS pbo, avg(ins) AS mean_is, avg(out) AS mean_oos, avg(out) / avg(ins) AS efficiency,
    CASE WHEN avg(CAST(rk < 0.5 AS DOUBLE)) < 0.4 THEN 'ROBUST' WHEN avg(CAST(rk < 0.5 AS DOUBLE)) < 0.55 THEN 'MODERATE' WHEN avg(CAST(rk < 0.5 AS DOUBLE)) < 0.7 THEN 'FRAGILE' ELSE 'OVERFIT' END AS verdict FROM (
    SELECT symbol, a, b, (count(*) FILTER (out <= best_out) - 0.5) / count(*) AS rk, any_value(best_in) AS ins, any_value(best_out) AS out FROM (
    SELECT *, first(ins) OVER w AS best_in, first(out) OVER w AS best_out FROM ({_splits(purge, embargo)})
    WINDOW w AS (PARTITION BY symbol, a, b ORDER BY ins DESC, fast ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1, 2, 3) GROUP BY 1"""


@query("symbol verdict", "splits", "pbo mean_is mean_oos efficiency", _cpcv(0, 0), "px pr grid gsim", places=6)
def cpcv_pbo(v):
    return search.cpcv_pbo(search.grid_returns(v.px, _FAST), "fast", ["symbol"])


@query("symbol verdict", "splits", "pbo mean_is mean_oos efficiency", _cpcv(5, 8), "px pr grid gsim", places=6)
def cpcv_purged(v):
    return search.cpcv_pbo(search.grid_returns(v.px, _FAST), "fast", ["symbol"], purge=5, embargo=8)


@query("symbol verdict", "splits", "pbo mean_is mean_oos efficiency", _cpcv(250, 300), "px pr grid gsim", places=6)
def cpcv_long_purge(v):
    """Purge and embargo longer than a group, as labels of a year ask for."""
    return search.cpcv_pbo(search.grid_returns(v.px, _FAST), "fast", ["symbol"], purge=250, embargo=300)


@query("symbol", "splits", "rank_correlation", f"""WITH t AS ({_splits(5, 8)}) SELECT symbol, count(*) AS splits, coalesce(avg(s / nullif(sqrt(x * y), 0)), 0) AS rank_correlation FROM (
    SELECT symbol, a, b, sum(sign(p.ins - o.ins) * sign(p.out - o.out)) AS s, sum(abs(sign(p.ins - o.ins))) AS x, sum(abs(sign(p.out - o.out))) AS y FROM t AS p JOIN t AS o USING (symbol, a, b) WHERE p.fast < o.fast GROUP BY 1, 2, 3) GROUP BY 1""", "px pr grid gsim", places=6)  # fmt: skip
def cpcv_rank_correlation(v):
    return search.rank_stability(search.cpcv_sharpes(search.grid_returns(v.px, _FAST), "fast", ["symbol"], purge=5, embargo=8), "fast", ["symbol"])


@query("run_id verdict grade", "passed neutral fast", "score pbo", f"""WITH best AS (SELECT symbol, fast FROM (SELECT symbol, fast, avg(r) / stddev_samp(r) AS s FROM gsim GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY s DESC, fast) = 1),
    rets AS (SELECT symbol AS run_id, dt, r FROM gsim JOIN best USING (symbol, fast)), pbo AS ({_cpcv(5, 8)}),
    gates AS ({_gates(4, "SELECT symbol AS run_id, pbo FROM pbo")}) SELECT gates.*, fast, pbo FROM gates JOIN best ON best.symbol = gates.run_id JOIN pbo ON pbo.symbol = gates.run_id""", "px pr grid gsim", places=6)  # fmt: skip
def validate_search(v):
    """All twelve gates for the best length of each symbol, with the overfit probability of the search that chose it."""
    return validation.validate_search(search.grid_returns(v.px, _FAST), "fast", "symbol", purge=5, embargo=8)


@query("run_id phase", "n", "early late whole", """SELECT *, CASE WHEN n < 252 THEN 'INSUFFICIENT_DATA' WHEN n < 1008 AND NOT coalesce(late < early - 0.2, false) THEN 'EMERGENCE' WHEN late > early + 0.2 THEN 'EXPLOITATION' WHEN late < early - 0.2 THEN 'DECLINE' ELSE 'MATURITY' END AS phase FROM (
    SELECT run_id, n, avg(r) / stddev_samp(r) * sqrt(252) AS whole, avg(r) FILTER (i < k) / stddev_samp(r) FILTER (i < k) * sqrt(252) AS early, avg(r) FILTER (i >= n - 504) / stddev_samp(r) FILTER (i >= n - 504) * sqrt(252) AS late
    FROM (SELECT *, greatest(252, n // 3) AS k FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM rets)) GROUP BY 1, 2)""", "rets", places=6)  # fmt: skip
def lifecycle(v):
    return diagnosis.lifecycle(v.rets)


@query("run_id dt", "", "r", """SELECT run_id, dt, o AS r FROM (WITH RECURSIVE x AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY dt) AS i FROM rets),
    f AS (SELECT run_id, dt, i, r AS o, 1 + r AS e, greatest(1 + r, 1) AS p, (1 + r) / greatest(1 + r, 1) - 1 <= -0.1 AS down FROM x WHERE i = 1
      UNION ALL SELECT run_id, dt, i, o, e, p, e / p - 1 <= -0.1 OR (was AND e < p) FROM (SELECT *, greatest(p0, e) AS p FROM (SELECT *, e0 * (1 + o) AS e FROM (SELECT x.run_id, x.dt, x.i, CASE WHEN f.down THEN x.r * 0.5 ELSE x.r END AS o, f.e AS e0, f.p AS p0, f.down AS was FROM f JOIN x ON x.run_id = f.run_id AND x.i = f.i + 1))))
    SELECT * FROM f)""", "rets", places=12)  # fmt: skip
def drawdown_throttle(v):
    return allocation.throttle(v.rets)


@query("symbol dt", "label bars", "ret", """SELECT symbol, dt, CASE WHEN u > 10 AND d > 10 THEN 0 WHEN u <= d THEN 1 ELSE -1 END AS label, least(u, d, n) AS bars, list_extract(ahead, least(u, d, n)) / price - 1 AS ret FROM (
    SELECT a.symbol, a.dt, any_value(a.price) AS price, coalesce(min(b.rn - a.rn) FILTER (b.price >= a.price * (1 + 1.5 * a.vol)), 11) AS u, coalesce(min(b.rn - a.rn) FILTER (b.price <= a.price * (1 - 1.0 * a.vol)), 11) AS d, count(*) AS n, list(b.price ORDER BY b.rn) AS ahead
    FROM (SELECT p.*, coalesce(vol, 0) AS vol FROM n AS p LEFT JOIN (SELECT symbol, rn, CASE WHEN count(*) >= 2 THEN sqrt(greatest((sum(w * lr * lr) / sum(w) - pow(sum(w * lr) / sum(w), 2)) * pow(sum(w), 2) / (pow(sum(w), 2) - sum(w * w)), 0)) END AS vol
        FROM (SELECT x.symbol, x.rn, y.lr, pow(1 - 2 / 101e0, x.rn - y.rn) AS w FROM n AS x JOIN n AS y ON x.symbol = y.symbol AND y.rn <= x.rn AND y.lr IS NOT NULL) GROUP BY 1, 2) USING (symbol, rn)) a
    JOIN n AS b ON a.symbol = b.symbol AND b.rn BETWEEN a.rn + 1 AND a.rn + 10 GROUP BY a.symbol, a.dt)""".replace(" n AS ", " (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn, ln(price / lag(price) OVER (PARTITION BY symbol ORDER BY dt)) AS lr FROM px) AS "), "px")  # fmt: skip
def triple_barrier(v):
    return signals.triple_barrier(v.px, 10, 1.5, 1.0)


_LEDGER = """SELECT symbol, min(dt) AS entry, max(dt) AS exit, count(*) AS bars, avg(w) AS avg_weight, max(abs(w)) AS max_weight, count(*) FILTER (abs(w - pw) > 1e-12) AS rebalances, sum(pnl) AS contribution, least(min(cum), 0) AS mae, greatest(max(cum), 0) AS mfe, CASE WHEN avg(w) > 0 THEN 'long' ELSE 'short' END AS side FROM (
    SELECT *, sum(pnl) OVER k AS cum, lag(w) OVER k AS pw FROM (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY dt) AS isl FROM (SELECT *, CASE WHEN (w <> 0) IS DISTINCT FROM lag(w <> 0) OVER q THEN 1 ELSE 0 END AS c, coalesce(lag(w) OVER q * ret, 0) AS pnl FROM (
    SELECT symbol, dt, ret, CASE WHEN n < 20 THEN 0 WHEN price > s * 1.01 THEN 1.0 WHEN price > s THEN 0.5 WHEN price < s * 0.97 THEN -0.5 ELSE 0 END AS w FROM (SELECT *, count(price) OVER j AS n, avg(price) OVER j AS s FROM pr WINDOW j AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)))
    WINDOW q AS (PARTITION BY symbol ORDER BY dt))) WHERE w <> 0 WINDOW k AS (PARTITION BY symbol, isl ORDER BY dt)) GROUP BY symbol, isl"""


def _spells(v):
    mean = panel.rolling(F.col("price"), 20, panel.along("symbol"))
    p = v.pr.withColumn("s", mean)
    w = F.when(F.col("s").isNull(), 0.0).when(F.col("price") > F.col("s") * 1.01, 1.0).when(F.col("price") > F.col("s"), 0.5).when(F.col("price") < F.col("s") * 0.97, -0.5).otherwise(0.0)
    return simulate.position_ledger(p.withColumn("w", w), ("symbol",))


@query("symbol entry exit side", "bars rebalances", "avg_weight max_weight contribution mae mfe", _LEDGER, "px pr")
def position_ledger(v):
    return _spells(v)


@query("symbol", "n longs", "hit_rate avg_bars avg_contribution best worst worst_mae profit_factor", f"""SELECT symbol, count(*) AS n, count(*) FILTER (side = 'long') AS longs, avg(CAST(contribution > 0 AS DOUBLE)) AS hit_rate, avg(bars) AS avg_bars, avg(contribution) AS avg_contribution, max(contribution) AS best, min(contribution) AS worst, min(mae) AS worst_mae,
    sum(greatest(contribution, 0)) / nullif(-sum(least(contribution, 0)), 0) AS profit_factor FROM ({_LEDGER}) GROUP BY 1""", "px pr", places=6)  # fmt: skip
def ledger_summary(v):
    c = F.col("contribution")
    return _spells(v).groupBy("symbol").agg(
        F.count("*").alias("n"), F.count_if(F.col("side") == "long").alias("longs"), F.avg((c > 0).cast("double")).alias("hit_rate"), F.avg("bars").alias("avg_bars"), F.avg(c).alias("avg_contribution"), F.max(c).alias("best"), F.min(c).alias("worst"),
        F.min("mae").alias("worst_mae"), F.try_divide(F.sum(F.greatest(c, F.lit(0.0))), -F.sum(F.least(c, F.lit(0.0)))).alias("profit_factor"),
    )


@query("p_partkey", "positions", "one_way drag recall borrow", """SELECT p_partkey, CASE WHEN trade <= 0 THEN 0 WHEN imax > 20 THEN greatest(floor(greatest(floor(adv * 1e-2 / trade), 1) * pow(20 / imax, 2)), 1) ELSE greatest(floor(adv * 1e-2 / trade), 1) END AS positions,
    CASE WHEN adv <= 0 THEN 25 ELSE least(greatest(50 - 5 * log10(greatest(adv * p_retailprice, 1)), 1), 500) / 2 END + CASE WHEN adv <= 0 OR trade <= 0 THEN 0 ELSE least(0.02 * sqrt(trade / adv) * 1e4, 500) END + 1 AS one_way,
    0.3 * 50 / 1e4 + greatest(p_size / 25e0 - 1, 0) * 0.0533 AS drag, 1 - exp(-hz * p_size) AS recall, br AS borrow FROM (
    SELECT p_partkey, p_size, p_retailprice, (p_size - 3) * 1000e0 AS adv, (p_partkey % 7) * 100e0 AS trade, CASE WHEN p_size > 3 THEN least(0.02 * sqrt(1e-2) * 1e4, 500) ELSE 0 END AS imax,
    CASE p_partkey % 5 WHEN 0 THEN 0.001 WHEN 1 THEN 0.003 WHEN 2 THEN 0.015 WHEN 3 THEN 0.05 ELSE 0.003 END AS hz, CASE p_partkey % 5 WHEN 0 THEN 0.005 WHEN 1 THEN 0.015 WHEN 2 THEN 0.075 WHEN 3 THEN 0.2 ELSE 0.015 END AS br FROM part)""")  # fmt: skip
def trading_costs(v):
    p = v.table("part").withColumn("adv", (F.col("p_size") - 3) * 1000.0).withColumn("trade", (F.col("p_partkey") % 7) * 100.0)
    tier = F.element_at(F.array(*map(F.lit, ("easy", "general", "hard", "specials", "unknown"))), (F.col("p_partkey") % 5 + 1).cast("int"))
    return p.select(
        "p_partkey", diagnosis.most_positions(F.col("trade"), F.col("adv")).alias("positions"), diagnosis.one_way_bps(F.col("trade"), F.col("adv"), F.col("p_retailprice")).alias("one_way"),
        diagnosis.financing_drag(F.lit(0.3), F.lit(50.0), F.col("p_size") / 25.0).alias("drag"), diagnosis.recall_risk(F.col("p_size"), tier).alias("recall"), diagnosis.by_tier(tier, diagnosis.BORROW_RATES).alias("borrow"),
    )


@query("run_id", "", "capital impact_bps sharpe", """SELECT run_id, capital, bps AS impact_bps, greatest(base - bps / 1e4 * 252 / greatest(sd * sqrt(252), 0.01), 0) AS sharpe FROM (SELECT *, sd * 0.314 * sqrt(least(capital / 1e7, 1)) * 1e4 + 0.1 * least(capital / 1e7, 1) * 1e4 AS bps FROM (
    SELECT run_id, avg(r) / stddev_samp(r) * sqrt(252) AS base, stddev_samp(r) AS sd FROM rets GROUP BY 1) CROSS JOIN (SELECT unnest([1e3, 1e4, 1e5, 1e6, 1e7, 1e8]) AS capital))""", "rets", places=6)  # fmt: skip
def capital_scaling(v):
    return diagnosis.capital_scaling(v.rets, [1e3, 1e4, 1e5, 1e6, 1e7, 1e8])


@query("cadence", "ppy", "gap", """SELECT cadence, gap, CASE WHEN n < 3 OR gap <= 2 THEN 252 WHEN gap <= 9 THEN 52 WHEN gap <= 45 THEN 12 ELSE 1 END AS ppy FROM (SELECT cadence, count(*) AS n, median(g) AS gap FROM (
    SELECT cadence, date_diff('day', lag(dt) OVER (PARTITION BY cadence ORDER BY dt), dt) AS g FROM (SELECT 'day' AS cadence, dt FROM rets WHERE run_id = 'A' UNION SELECT 'week', CAST(date_trunc('week', dt) AS DATE) FROM rets WHERE run_id = 'A' UNION SELECT 'month', CAST(date_trunc('month', dt) AS DATE) FROM rets WHERE run_id = 'A' UNION SELECT 'year', CAST(date_trunc('year', dt) AS DATE) FROM rets WHERE run_id = 'A')) GROUP BY 1)""", "rets")  # fmt: skip
def periods_per_year(v):
    days = v.rets.where("run_id = 'A'")
    cut = [days.select(F.lit(c).alias("cadence"), (F.col("dt") if c == "day" else F.to_date(F.date_trunc(c, "dt"))).alias("dt")) for c in ("day", "week", "month", "year")]
    every = cut[0].unionByName(cut[1]).unionByName(cut[2]).unionByName(cut[3]).distinct()
    return diagnosis.periods_per_year(every, "cadence")


@query("run_id", "", "p_value", """SELECT run_id, (count(*) FILTER (mean >= seen) + 1) / 201e0 AS p_value FROM (SELECT run_id, draw, avg(CASE WHEN substr(md5(draw || '-' || i), 1, 1) < '8' THEN r ELSE -r END) AS mean FROM (SELECT run_id, r, row_number() OVER (PARTITION BY run_id ORDER BY dt) AS i FROM rets) CROSS JOIN (SELECT unnest(range(1, 201)) AS draw) GROUP BY 1, 2)
    JOIN (SELECT run_id, avg(r) AS seen FROM rets GROUP BY 1) USING (run_id) GROUP BY 1""", "rets")  # fmt: skip
def sign_permutation(v):
    return diagnosis.sign_permutation(v.rets, 200)


@query("symbol dt", "", "close factor adj_close", """SELECT symbol, dt, close, coalesce(exp(sum(ln(f)) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) AS factor, close * coalesce(exp(sum(ln(f)) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)), 1) AS adj_close FROM (
    SELECT symbol, dt, price AS close, CASE WHEN lag(price) OVER w IS NULL THEN 1 ELSE (1 - CASE WHEN month(dt) IN (3, 9) AND day(dt) <= 5 THEN 0.4 ELSE 0 END / lag(price) OVER w) / CASE WHEN month(dt) = 6 AND day(dt) = 15 THEN 2 ELSE 1 END END AS f FROM px WINDOW w AS (PARTITION BY symbol ORDER BY dt))""", "px", places=6)  # fmt: skip
def adjusted_prices(v):
    """Splits of two for one on 15 June, written as ratios, and small dividends in March and September."""
    px = v.px.withColumnRenamed("price", "close")
    dividends = px.where("month(dt) in (3, 9) and day(dt) <= 5").select("symbol", "dt", F.lit(0.4).alias("dividend"))
    splits = panel.parse_splits(px.where("month(dt) = 6 and day(dt) = 15").select("symbol", "dt", F.lit("2/1").alias("split")).unionByName(px.limit(0).select("symbol", "dt", F.lit("x").alias("split"))))
    return panel.adjust_prices(px, dividends, splits)


@query("member start_dt end_dt", "", "", """SELECT member, dt AS start_dt, CAST(nxt AS VARCHAR) AS end_dt FROM (SELECT member, action, dt, lead(dt) OVER (PARTITION BY member ORDER BY dt, action) AS nxt FROM (SELECT *, lag(action) OVER (PARTITION BY member ORDER BY dt, action) AS before FROM (
    SELECT o_custkey AS member, CAST(o_orderdate AS DATE) AS dt, max(CASE WHEN o_orderkey % 3 = 0 THEN 'removed' ELSE 'added' END) AS action FROM orders GROUP BY 1, 2)) WHERE action IS DISTINCT FROM before AND NOT (before IS NULL AND action = 'removed')) WHERE action = 'added'""")  # fmt: skip
def membership_intervals(v):
    o = v.table("orders").groupBy(F.col("o_custkey").alias("member"), F.to_date("o_orderdate").alias("dt"))
    spans = panel.membership_intervals(o.agg(F.max(F.when(F.col("o_orderkey") % 3 == 0, "removed").otherwise("added")).alias("action")))
    return spans.withColumn("end_dt", F.col("end_dt").cast("string"))


@query("run_id regime", "n", "var cvar mean_return vol sharpe", """SELECT run_id, regime, count(*) AS n, any_value(q) AS var, avg(r) FILTER (r <= q) AS cvar, avg(r) AS mean_return, stddev_samp(r) AS vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM (SELECT *, CASE WHEN n > 0 THEN 'up' ELSE 'down' END AS regime FROM (SELECT rets.run_id, rets.dt, rets.r, wide.n FROM rets JOIN wide ON rets.dt = wide.dt))
    JOIN (SELECT run_id, regime, quantile_cont(r, 0.05) AS q FROM (SELECT run_id, r, CASE WHEN n > 0 THEN 'up' ELSE 'down' END AS regime FROM rets JOIN wide ON rets.dt = wide.dt) GROUP BY 1, 2) USING (run_id, regime) GROUP BY 1, 2""", "rets wide", places=6)  # fmt: skip
def regime_risk(v):
    labels = v.wide.select("dt", F.when(F.col("n") > 0, "up").otherwise("down").alias("regime"))
    return inference.risk_by_regime(v.rets.join(labels, "dt"))


@query("symbol start_dt end_dt regime", "bars", "", """SELECT symbol, min(dt) AS start_dt, max(dt) AS end_dt, any_value(regime) AS regime, count(*) AS bars FROM (SELECT *, sum(c) OVER (PARTITION BY symbol ORDER BY dt) AS isl FROM (SELECT *, CASE WHEN regime IS DISTINCT FROM lag(regime) OVER (PARTITION BY symbol ORDER BY dt) THEN 1 ELSE 0 END AS c FROM (
    SELECT symbol, dt, coalesce(lag(g) OVER (PARTITION BY symbol ORDER BY dt), 'Bear-Mid') AS regime FROM (SELECT symbol, dt, CASE WHEN k < 200 THEN 'Bear-Mid' ELSE CASE WHEN price > ma THEN 'Bull' ELSE 'Bear' END || CASE WHEN nv >= 63 AND vol <= 0.12 THEN '-Calm' WHEN nv >= 63 AND vol >= 0.2 THEN '-Stress' ELSE '-Mid' END END AS g FROM (
    SELECT symbol, dt, price, count(*) OVER a AS k, avg(price) OVER a AS ma, count(*) OVER b AS nv, stddev_samp(coalesce(ret, 0)) OVER b * sqrt(252) AS vol FROM pr WINDOW a AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 199 PRECEDING AND CURRENT ROW), b AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)))))) GROUP BY symbol, isl""", "px pr")  # fmt: skip
def regime_timeline(v):
    return signals.timeline(signals.market_regimes(v.pr), "symbol", "regime")


_PSR = cdf("z")


@query("symbol priority", "fast candidates", "sharpe cagr psr", f"""SELECT symbol, CASE WHEN candidates > 0 THEN 'ROBUST_PERF' ELSE 'REJECTED' END AS priority, candidates, CASE WHEN candidates > 0 THEN fast ELSE 0 END AS fast, CASE WHEN candidates > 0 THEN sharpe END AS sharpe, CASE WHEN candidates > 0 THEN cagr END AS cagr, CASE WHEN candidates > 0 THEN psr END AS psr FROM (
    SELECT *, count(*) FILTER (good) OVER (PARTITION BY symbol) AS candidates, row_number() OVER (PARTITION BY symbol ORDER BY good DESC, greatest(cagr, 0) * ln(1 + active) DESC, sharpe DESC, cagr DESC, fast) AS k FROM (
    SELECT *, sharpe >= 0.3 AND psr >= 0.6 AND cagr > -0.05 AND mdd > -0.999 AS good FROM (SELECT *, {_PSR} AS psr FROM (
    SELECT symbol, fast, sr * sqrt(252) AS sharpe, cagr, mdd, active, sr / sqrt(greatest(1 + 0.5 * sr * sr - skew * sr + kurt / 4 * sr * sr, 0) / (n - 1)) AS z FROM (
    SELECT symbol, fast, count(r) AS n, avg(r) / stddev_samp(r) AS sr, (avg(r*r*r) - 3*avg(r)*avg(r*r) + 2*pow(avg(r),3)) / pow(var_pop(r), 1.5) AS skew, kurtosis_pop(r) AS kurt, exp(sum(ln(1 + r)) * 252 / count(r)) - 1 AS cagr, min(exp(le - peak) - 1) AS mdd, count(*) FILTER (r <> 0) AS active
    FROM (SELECT *, max(le) OVER (PARTITION BY symbol, fast ORDER BY dt) AS peak FROM (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY symbol, fast ORDER BY dt) AS le FROM gsim)) GROUP BY 1, 2))))) WHERE k = 1""", "px pr grid gsim", places=6)  # fmt: skip
def robust_selection(v):
    return search.robust_choice(search.grid_returns(v.px, _FAST), "fast", "symbol").fillna({"fast": 0})


@query("run_id", "", "weight ret_contrib ret_share risk_share sharpe", """SELECT k.run_id, 1 / 3e0 AS weight, mu * 252 / 3 AS ret_contrib, mu / (SELECT sum(mu) FROM s) AS ret_share, c / (SELECT sum(c) FROM k2) AS risk_share, mu / sd * sqrt(252) AS sharpe FROM s AS k JOIN k2 USING (run_id)""".replace("FROM s)", "FROM (SELECT run_id, avg(x) AS mu FROM l GROUP BY 1))").replace("FROM s AS", "FROM (SELECT run_id, avg(x) AS mu, stddev_samp(x) AS sd FROM l GROUP BY 1) AS").replace("k2", "(SELECT run_id, covar_samp(x, m) AS c FROM l GROUP BY 1)").replace(
    "FROM l ", "FROM (SELECT 'A' AS run_id, a AS x, (a + n + f) / 3 AS m FROM wide UNION ALL SELECT 'N', n, (a + n + f) / 3 FROM wide UNION ALL SELECT 'R', f, (a + n + f) / 3 FROM wide) "), "rets wide", places=6)
def book_attribution(v):
    long = v.wide.select("dt", F.inline(F.array(*[F.struct(F.lit(k).alias("run_id"), F.col(x).alias("r")) for k, x in (("A", "a"), ("N", "n"), ("R", "f"))])))
    return inference.book_attribution(long.withColumn("w", F.lit(1 / 3)))


@query("run_id", "", "ruin", """SELECT run_id, avg(CAST(worst <= -0.02 AS DOUBLE)) AS ruin FROM (SELECT run_id, draw, min(exp(e - p) - 1) AS worst FROM (SELECT *, max(e) OVER (PARTITION BY run_id, draw ORDER BY pos) AS p FROM (SELECT run_id, draw, pos, sum(ln(1 + r)) OVER (PARTITION BY run_id, draw ORDER BY pos) AS e FROM (
    SELECT run_id, draw, pos, CAST('0x' || substr(md5(draw || ':' || pos), 1, 8) AS BIGINT) % n AS i FROM (SELECT run_id, count(*) AS n FROM rets GROUP BY 1) CROSS JOIN (SELECT unnest(range(100)) AS draw) CROSS JOIN (SELECT unnest(range(252)) AS pos)) JOIN (SELECT run_id, r, row_number() OVER (PARTITION BY run_id ORDER BY dt) - 1 AS i FROM rets) USING (run_id, i))) GROUP BY 1, 2) GROUP BY 1""", "rets")  # fmt: skip
def ruin_probability(v):
    return inference.ruin(v.rets, -0.02, 252, 100)
