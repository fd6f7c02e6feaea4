"""Queries: several breaks, rolling rank correlation, intrabar exits, surrogates and noise, model sets, best-of-many Sharpes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions import stats
from tessella.operators import intrabar, panel, resample, rolling_rank, search, structure, surrogates

from .inference import cdf, ppf
from .registry import query

_FAST = [10, 20, 40, 60]
_RULE = "SELECT symbol AS run_id, dt, r FROM gsim WHERE fast = 20"
_NUMBERED = "SELECT run_id, dt, r, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n, sum(r * r) OVER w AS c FROM rets WINDOW w AS (PARTITION BY run_id ORDER BY dt)"


def _variance_sql(rounds: int) -> str:
    """Segments as a table that splits in rounds, each searched by a join on its bounds."""
    out = f"WITH p AS ({_NUMBERED.replace('rets', f'({_RULE})')}), e0 AS (SELECT run_id, any_value(n) AS n, 0 AS lo, any_value(n) AS hi FROM p GROUP BY 1)"
    for k in range(rounds):
        out += f""", t{k} AS (SELECT run_id, n, lo, hi, arg_max(i, far) AS pos, max(far) AS far FROM (SELECT e.*, p.i, abs((p.c - coalesce(a.c, 0)) / nullif(z.c - coalesce(a.c, 0), 0) - (p.i - lo + 1.0) / (hi - lo)) AS far FROM e{k} AS e
            LEFT JOIN p AS a ON a.run_id = e.run_id AND a.i = lo - 1 JOIN p AS z ON z.run_id = e.run_id AND z.i = hi - 1 JOIN p ON p.run_id = e.run_id AND p.i >= lo AND p.i < hi) GROUP BY ALL),
        c{k} AS (SELECT *, n >= 50 AND hi - lo >= 10 AND pos > lo + 5 AND pos < hi - 5 AND sqrt((hi - lo) / 2.0) * far > 1.358 AS cut FROM t{k}),
        e{k + 1} AS (SELECT run_id, n, lo, CASE WHEN cut THEN pos ELSE hi END AS hi FROM c{k} UNION ALL SELECT run_id, n, pos, hi FROM c{k} WHERE cut)"""
    return out + f" SELECT p.run_id, dense_rank() OVER (PARTITION BY p.run_id ORDER BY lo) - 1 AS segment, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS n, avg(r * r) AS variance FROM p JOIN e{rounds} AS e ON p.run_id = e.run_id AND i >= lo AND i < hi GROUP BY p.run_id, lo"


@query("run_id start_dt end_dt", "segment n", "variance", _variance_sql(5), "px pr grid gsim", places=10)
def variance_breaks(v):
    return structure.variance_breaks(search.grid_returns(v.px, [20]).withColumnRenamed("symbol", "run_id"))


def _mean_sql(least: int, rounds: int) -> str:
    ssr = lambda a, b: f"({b}.q - {a}.q - pow({b}.s - {a}.s, 2) / ({b}.i - {a}.i))"
    out = f"""WITH p AS ({_NUMBERED}), x AS (SELECT run_id, i, n, coalesce(sum(r) OVER w, 0) AS s, coalesce(sum(r * r) OVER w, 0) AS q FROM p WINDOW w AS (PARTITION BY run_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        UNION ALL SELECT run_id, count(*), count(*), sum(r), sum(r * r) FROM p GROUP BY 1),
        e0 AS (SELECT run_id, 0 AS lo, count(*) AS hi FROM p GROUP BY 1)"""
    for k in range(rounds):
        out += f""", g{k} AS (SELECT run_id, arg_max(i, gain) AS pos, max(gain) AS gain FROM (SELECT m.run_id, m.i, {ssr('a', 'b')} - {ssr('a', 'm')} - {ssr('m', 'b')} AS gain FROM e{k} AS e JOIN x AS a ON a.run_id = e.run_id AND a.i = lo JOIN x AS b ON b.run_id = e.run_id AND b.i = hi
            JOIN x AS m ON m.run_id = e.run_id AND m.i >= lo + {least} AND m.i <= hi - {least} AND m.i < m.n - {least}) GROUP BY 1),
        e{k + 1} AS (SELECT e.run_id, lo, CASE WHEN pos > lo AND pos < hi THEN pos ELSE hi END AS hi FROM e{k} AS e LEFT JOIN g{k} USING (run_id) UNION ALL SELECT e.run_id, pos, hi FROM e{k} AS e JOIN g{k} USING (run_id) WHERE pos > lo AND pos < hi)"""
    placed = " UNION ALL ".join(f"SELECT run_id, {k + 1} AS k, pos, gain FROM g{k}" for k in range(rounds))
    return out + f""", placed AS ({placed}), whole AS (SELECT run_id, count(*) AS n, var_pop(r) * count(*) AS ssr FROM p GROUP BY 1),
        curve AS (SELECT run_id, 0 AS k, n * ln(greatest(ssr / n, 1e-12)) + 2 * ln(n) AS bic FROM whole UNION ALL
                  SELECT run_id, k, n * ln(greatest((ssr - sum(gain) OVER (PARTITION BY run_id ORDER BY k)) / n, 1e-12)) + (2 * k + 1) * ln(n) FROM placed JOIN whole USING (run_id)),
        won AS (SELECT run_id, arg_min(k, (bic, k)) AS breaks FROM curve GROUP BY 1),
        seg AS (SELECT p.*, breaks, (SELECT count(*) FROM placed AS b WHERE b.run_id = p.run_id AND b.k <= won.breaks AND b.pos <= p.i) AS segment FROM p JOIN won USING (run_id))
        SELECT run_id, segment, min(dt) AS start_dt, max(dt) AS end_dt, count(*) AS n, avg(r) AS mean, coalesce(stddev_samp(r), 0) AS sd, any_value(breaks) AS breaks,
          CASE WHEN any_value(n) < {2 * least} THEN 'INSUFFICIENT_DATA' WHEN any_value(breaks) = 0 THEN 'STABLE' WHEN any_value(breaks) <= 2 THEN 'SHIFTING' ELSE 'FRAGMENTED' END AS verdict FROM seg GROUP BY 1, 2"""


@query("run_id start_dt end_dt verdict", "segment n breaks", "mean sd", _mean_sql(63, 5), "rets")
def mean_breaks(v):
    return structure.mean_breaks(v.rets, least=63)


_ROLLING = """WITH s AS (SELECT symbol, dt, signal AS x, fwd AS y, row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1 AS i FROM sig),
    k AS (SELECT symbol, dt, rank() OVER (PARTITION BY symbol, dt ORDER BY x) + (count(*) OVER (PARTITION BY symbol, dt, x) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol, dt ORDER BY y) + (count(*) OVER (PARTITION BY symbol, dt, y) - 1) / 2.0 AS b
          FROM (SELECT e.symbol, e.dt, b.x, b.y FROM s AS e JOIN s AS b ON b.symbol = e.symbol AND b.i BETWEEN e.i - 59 AND e.i WHERE e.i >= 59) WHERE x IS NOT NULL AND y IS NOT NULL),
    c AS (SELECT symbol, dt, CASE WHEN count(*) >= 5 AND var_pop(a) > 0 AND var_pop(b) > 0 THEN corr(a, b) END AS ic FROM k GROUP BY 1, 2)
    SELECT symbol, dt, coalesce(ic, 0) AS ic FROM s LEFT JOIN c USING (symbol, dt) WHERE i >= 59"""


@query("symbol dt", "", "ic", _ROLLING, "px pr sig")
def rolling_rank_ic(v):
    return rolling_rank.rolling_rank_ic(v.sig, "symbol", "signal", "fwd", 60)


@query("symbol", "windows", "ic_mean ic_std ic_ir", f"SELECT symbol, count(*) AS windows, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(ic) / stddev_samp(ic) AS ic_ir FROM ({_ROLLING}) GROUP BY 1", "px pr sig")
def rolling_ic_ratio(v):
    return rolling_rank.ic_ratio(rolling_rank.rolling_rank_ic(v.sig, "symbol", "signal", "fwd", 60), "symbol")


#: how trades (symbol, session, bar, entry, side, stop, target) of a table e end: `touched`
TOUCHED = """j AS (SELECT e.*, b.bar AS pos, b.close, (CASE WHEN side = 1 THEN b.low ELSE b.high END - entry) * side AS mark, CASE WHEN side = 1 THEN b.low <= stop ELSE b.high >= stop END AS st, CASE WHEN side = 1 THEN b.high >= target ELSE b.low <= target END AS tg
          FROM e LEFT JOIN bars AS b ON b.symbol = e.symbol AND b.session = e.session AND b.bar > e.bar),
    x AS (SELECT *, min(CASE WHEN st OR tg THEN pos END) OVER o AS hit, max(pos) OVER o AS fin FROM j WINDOW o AS (PARTITION BY symbol, session, bar)),
    d AS (SELECT symbol, session, bar, side, entry, coalesce(hit, fin) AS exit_bar, CASE WHEN fin IS NULL THEN 'none' WHEN hit IS NULL THEN 'end' WHEN bool_or(st) FILTER (pos = hit) THEN 'stop' ELSE 'target' END AS outcome,
            any_value(stop) AS stop, any_value(target) AS target, max(close) FILTER (pos = fin) AS fin_close, least(coalesce(min(mark) FILTER (pos <= coalesce(hit, fin)), 0), 0) AS mark FROM x GROUP BY symbol, session, bar, side, entry, hit, fin),
    touched AS (SELECT *, CASE WHEN outcome IN ('stop', 'end') THEN least(mark, pnl) ELSE mark END AS worst FROM (SELECT *, CASE outcome WHEN 'stop' THEN (stop - entry) * side WHEN 'target' THEN (target - entry) * side WHEN 'end' THEN (fin_close - entry) * side ELSE 0 END AS pnl FROM d))"""


@query("symbol bar exit_bar outcome", "side", "entry pnl worst", f"""WITH e AS (SELECT symbol, session, bar, entry, side, entry * (1 - 0.05e0 * side) AS stop, entry * (1 + 0.1e0 * side) AS target FROM (
      SELECT symbol, session, bar, close AS entry, CASE WHEN close > sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w THEN 1 ELSE -1 END AS side FROM bars WINDOW w AS (PARTITION BY symbol, session ORDER BY bar))),
    {TOUCHED} SELECT * FROM touched""", "ticks bars")  # fmt: skip
def stop_before_target(v):
    e = panel.session_vwap(v.bars).withColumn("entry", F.col("close")).withColumn("side", F.when(F.col("close") > F.col("vwap"), 1).otherwise(-1))
    e = e.select("symbol", "session", "bar", "entry", "side", (F.col("entry") * (1 - 0.05 * F.col("side"))).alias("stop"), (F.col("entry") * (1 + 0.1 * F.col("side"))).alias("target"))
    return intrabar.first_touch(e, v.bars)


@query("symbol significant", "n", "sharpe surrogate_mean surrogate_p95 p_value", None)
def surrogate_prices(v):
    """SQL has no Fourier transform of practical cost; tests hold spectrum, phases and p-value against NumPy."""
    return surrogates.surrogate_test(v.px, lambda p: search.grid_returns(p, [20]).select("symbol", "dt", "r"), 40)


def _hash(x: str) -> str:
    return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"


def _uniform(x: str) -> str:
    return f"(({_hash(x)} + 0.5e0) / 4294967296.0e0)"


_NOISE = f"""SELECT run_id, level, n, base, sharpe, CASE WHEN base > 1e-9 THEN greatest((base - arg_max(sharpe, level) OVER (PARTITION BY run_id)) / base / 1.0, 0) END AS fragility FROM (
    SELECT run_id, level, any_value(n) AS n, any_value(base) AS base, avg(s) AS sharpe FROM (SELECT run_id, level, draw, any_value(n) AS n, any_value(base) AS base, avg(r + level * z) / stddev_samp(r + level * z) * sqrt(252) AS s FROM (
    SELECT run_id, draw, n, base, r, sd * sqrt(-2 * ln({_uniform("'radius:' || draw || ':' || i")})) * cos(2 * pi() * {_uniform("'angle:' || draw || ':' || i")}) AS z FROM (
    SELECT run_id, r, row_number() OVER (PARTITION BY run_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n, stddev_samp(r) OVER (PARTITION BY run_id) AS sd, avg(r) OVER (PARTITION BY run_id) / stddev_samp(r) OVER (PARTITION BY run_id) * sqrt(252) AS base FROM rets)
    CROSS JOIN (SELECT unnest(range(60)) AS draw) WHERE n >= 32) CROSS JOIN (SELECT unnest([0.25e0, 0.5e0, 1.0e0]) AS level) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("run_id", "n", "level base sharpe fragility", _NOISE, "rets", places=6)
def noise_decay(v):
    return surrogates.noise_test(v.rets, [0.25, 0.5, 1.0], 60)


#: (symbol, draw, i): the rows that a family's draws take, block by block
_DRAWN = f"""b0 AS (SELECT symbol, n, draw, b, CAST(1 + floor(ln({_uniform("'len:' || draw || ':' || b")}) / ln(1 - 1 / 10e0)) AS BIGINT) AS len FROM (SELECT symbol, count(DISTINCT dt) AS n FROM gsim GROUP BY 1) CROSS JOIN (SELECT unnest(range(60)) AS draw) CROSS JOIN (SELECT unnest(range(2000)) AS b) WHERE b < ceil(n / 10e0 + 8 * sqrt(n / 10e0) + 16)),
    b1 AS (SELECT * FROM (SELECT *, sum(len) OVER (PARTITION BY symbol, draw ORDER BY b) AS upto FROM b0) WHERE upto - len < n),
    b2 AS (SELECT symbol, n, draw, {_hash("'at:' || draw || ':' || b")} % n AS start, CASE WHEN lead(b) OVER (PARTITION BY symbol, draw ORDER BY b) IS NULL THEN n - upto + len ELSE len END AS len FROM b1),
    picks AS (SELECT symbol, draw, (start + j) % n AS i FROM (SELECT symbol, n, draw, start, unnest(range(CAST(len AS BIGINT))) AS j FROM b2)),
    num AS (SELECT *, row_number() OVER (PARTITION BY symbol, fast ORDER BY dt) - 1 AS i, avg(r) OVER (PARTITION BY symbol, fast) AS mu FROM gsim)"""

_SET = f"""WITH {_DRAWN}, means AS (SELECT symbol, fast, avg(-r) AS mean, count(*) AS n, row_number() OVER (PARTITION BY symbol ORDER BY avg(-r), fast DESC) AS place FROM gsim GROUP BY 1, 2),
    boot AS (SELECT symbol, fast, draw, place, any_value(mean) AS mean, any_value(n) AS n, avg(-r) - any_value(mean) AS d FROM picks JOIN num USING (symbol, i) JOIN means USING (symbol, fast) GROUP BY 1, 2, 3, 4),
    pairs AS (SELECT symbol, x.draw, x.place AS a, y.place AS b, x.d - y.d AS d, abs(x.mean - y.mean) AS gap, x.n AS n, var_samp(x.d - y.d) OVER (PARTITION BY symbol, x.place, y.place) AS v FROM boot AS x JOIN boot AS y USING (symbol, draw) WHERE x.place < y.place),
    sets AS (SELECT symbol, k, draw, max(abs(d) / sqrt(v / n + 1e-30)) AS boot, max(gap / sqrt(v / n + 1e-30)) AS seen FROM pairs JOIN (SELECT unnest([2, 3, 4]) AS k) ON b <= k GROUP BY 1, 2, 3),
    p AS (SELECT symbol, k, avg(CAST(boot >= seen AS DOUBLE)) AS p FROM sets GROUP BY 1, 2), stop AS (SELECT symbol, max(k) AS stop FROM p WHERE p >= 0.1 GROUP BY 1)
    SELECT symbol, fast, place, mean AS mean_loss, CASE WHEN place > coalesce(stop, 1) THEN p END AS p_value, place <= coalesce(stop, 1) AS survives FROM means LEFT JOIN stop USING (symbol) LEFT JOIN p USING (symbol) WHERE k = place OR (place = 1 AND k = 2)"""


@query("symbol survives", "fast place", "mean_loss p_value", _SET, "px pr grid gsim", places=6)
def model_confidence_set(v):
    losses = search.grid_returns(v.px, _FAST).select("symbol", "fast", "dt", (-F.col("r")).alias("loss"))
    return resample.confidence_set(losses, "symbol", "fast", draws=60)


_TOP = f"((1 - {stats.EULER!r}) * {ppf('(1 - 1 / 4e0)')} + {stats.EULER!r} * {ppf('(1 - 1 / (4 * exp(1e0)))')})"
_WOLF = f"""WITH {_DRAWN}, boot AS (SELECT symbol, draw, max(s) AS top FROM (SELECT symbol, fast, draw, avg(r - mu) / stddev_samp(r - mu) AS s FROM picks JOIN num USING (symbol, i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
    each AS (SELECT symbol, fast, count(*) AS n, avg(r) / stddev_samp(r) AS sharpe, (avg(r*r*r) - 3*avg(r)*avg(r*r) + 2*pow(avg(r),3)) / pow(var_pop(r), 1.5) AS skew, kurtosis_pop(r) AS kurt FROM gsim GROUP BY 1, 2),
    best AS (SELECT * FROM each QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY sharpe DESC, fast) = 1),
    d AS (SELECT symbol, 4 AS trials, n, sharpe, expected_max, {_TOP} / sqrt(n - 1) AS expected_max_normal, sqrt((1 + 0.5 * sharpe * sharpe - skew * sharpe + kurt / 4 * sharpe * sharpe) / (n - 1)) AS se FROM best JOIN (SELECT symbol, avg(top) AS expected_max FROM boot GROUP BY 1) USING (symbol))
    SELECT *, {cdf('((sharpe - expected_max) / se)')} AS dsr, {cdf('((sharpe - expected_max_normal) / se)')} AS dsr_normal FROM d"""


@query("symbol", "trials n", "sharpe expected_max dsr expected_max_normal dsr_normal", _WOLF, "px pr grid gsim", places=6)
def romano_wolf(v):
    return resample.romano_wolf(search.grid_returns(v.px, _FAST), "symbol", "fast", 60)


_MANY = f"""SELECT run_id, sharpe, expected_max, sharpe / expected_max AS inflation, p AS p_value, CASE WHEN p < 0.05 THEN 'EDGE_BEYOND_OPTIM_BIAS' WHEN p < 0.2 THEN 'BORDERLINE' ELSE 'OPTIM_BIAS_LIKELY' END AS verdict FROM (
    SELECT run_id, sharpe, avg(top) AS expected_max, (1 + count(*) FILTER (top >= sharpe)) / (1.0 + count(*)) AS p FROM (SELECT run_id, draw, sharpe, max(s) AS top FROM (SELECT run_id, draw, a, any_value(sharpe) AS sharpe, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM (
    SELECT run_id, draw, a, sharpe, {_hash("draw || ':' || a || ':' || j")} % n AS i FROM (SELECT run_id, count(*) AS n, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM rets GROUP BY 1) CROSS JOIN (SELECT unnest(range(40)) AS draw) CROSS JOIN (SELECT unnest(range(5)) AS a) JOIN (SELECT unnest(range(100000)) AS j) ON j < n)
    JOIN (SELECT run_id, r, row_number() OVER (PARTITION BY run_id ORDER BY dt) - 1 AS i FROM rets) USING (run_id, i) GROUP BY 1, 2, 3) GROUP BY 1, 2, 3) GROUP BY 1, 2)"""


@query("run_id verdict", "", "sharpe expected_max inflation p_value", _MANY, "rets", places=6)
def best_of_many(v):
    return resample.best_of_many(v.rets, 5, draws=40)


_MEANS = """each AS (SELECT symbol, fast, count(*) AS n, avg(r) AS mean, stddev_samp(r) / sqrt(count(*)) AS scale FROM gsim GROUP BY 1, 2),
    boot AS (SELECT symbol, fast, draw, avg(r) AS boot FROM picks JOIN num USING (symbol, i) GROUP BY 1, 2, 3)"""


@query("symbol", "trials", "statistic p_value", f"""WITH {_DRAWN}, {_MEANS}, v AS (SELECT symbol, draw, max((boot - mean) * sqrt(n)) AS v FROM boot JOIN each USING (symbol, fast) GROUP BY 1, 2)
    SELECT symbol, trials, statistic, (1 + count(*) FILTER (v >= statistic)) / (1.0 + count(*)) AS p_value FROM v JOIN (SELECT symbol, count(*) AS trials, max(mean * sqrt(n)) AS statistic FROM each GROUP BY 1) USING (symbol) GROUP BY 1, 2, 3""", "px pr grid gsim", places=6)  # fmt: skip
def reality_check(v):
    return resample.reality_check(search.grid_returns(v.px, _FAST), "symbol", "fast", 60)


_ABLE = f"""WITH {_DRAWN}, {_MEANS}, t AS (SELECT *, mean / scale AS t, row_number() OVER (PARTITION BY symbol ORDER BY mean / scale DESC, fast) AS place FROM each),
    d AS (SELECT *, (boot - mean) / scale AS z FROM boot JOIN t USING (symbol, fast)),
    tops AS (SELECT symbol, draw, max(z) AS lo, max((boot - CASE WHEN t >= -sqrt(2 * ln(ln(greatest(n, 3)))) THEN mean ELSE 0 END) / scale) AS co, max(boot / scale) AS up FROM d GROUP BY 1, 2),
    p AS (SELECT symbol, statistic, trials, avg(CAST(lo >= statistic AS DOUBLE)) AS p_lower, avg(CAST(co >= statistic AS DOUBLE)) AS p_consistent, avg(CAST(up >= statistic AS DOUBLE)) AS p_upper FROM tops JOIN (SELECT symbol, max(t) AS statistic, count(*) AS trials FROM t GROUP BY 1) USING (symbol) GROUP BY 1, 2, 3),
    tails AS (SELECT symbol, k AS gone, quantile_cont(z, 0.95) AS bound FROM (SELECT symbol, draw, k, max(z) AS z FROM d JOIN (SELECT unnest(range(4)) AS k) ON place > k GROUP BY 1, 2, 3) GROUP BY 1, 2),
    nxt AS (SELECT symbol, gone, greatest(gone, count(*) FILTER (t > bound)) AS after FROM tails JOIN t USING (symbol) GROUP BY 1, 2),
    s0 AS (SELECT symbol, after AS g FROM nxt WHERE gone = 0), s1 AS (SELECT symbol, coalesce(after, g) AS g FROM s0 LEFT JOIN nxt ON nxt.symbol = s0.symbol AND nxt.gone = g), s2 AS (SELECT s1.symbol, coalesce(after, g) AS g FROM s1 LEFT JOIN nxt ON nxt.symbol = s1.symbol AND nxt.gone = g),
    s3 AS (SELECT s2.symbol, coalesce(after, g) AS g FROM s2 LEFT JOIN nxt ON nxt.symbol = s2.symbol AND nxt.gone = g)
    SELECT p.*, g AS rejected FROM p JOIN s3 USING (symbol)""".replace("SELECT symbol, coalesce(after, g) AS g FROM s0", "SELECT s0.symbol, coalesce(after, g) AS g FROM s0")


@query("symbol", "trials rejected", "statistic p_lower p_consistent p_upper", _ABLE, "px pr grid gsim", places=6)
def superior_ability(v):
    return resample.superior_ability(search.grid_returns(v.px, _FAST), "symbol", "fast", 60)
