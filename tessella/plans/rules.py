"""Queries: the trading rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.operators import panel, session_trades, simulate, strategies

from .registry import query
from .structure import TOUCHED

_SESSIONS = """(SELECT symbol, session, arg_min(open, bar) AS open, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close, count(*) AS n, max(open) FILTER (k = 2) AS second_open
    FROM (SELECT *, row_number() OVER (PARTITION BY symbol, session ORDER BY bar) AS k FROM bars) GROUP BY 1, 2)"""


@query("symbol dt", "", "w", """SELECT symbol, dt, CASE WHEN count(price) OVER s < 100 THEN 0.0 WHEN avg(price) OVER f > avg(price) OVER s THEN 1.0 ELSE -1.0 END AS w FROM px
    WINDOW f AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), s AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""", "px")  # fmt: skip
def ma_crossover(v):
    return strategies.ma_crossover(v.px)


@query("month symbol", "", "w", """SELECT month, symbol, coalesce(on_ / nullif(sum(on_) OVER (PARTITION BY month), 0), 0) AS w FROM (SELECT month, symbol, CAST(count(*) OVER k >= 10 AND p > avg(p) OVER k AS INT) AS on_
    FROM (SELECT symbol, CAST(date_trunc('month', dt) AS DATE) AS month, arg_max(price, dt) AS p FROM px GROUP BY 1, 2) WINDOW k AS (PARTITION BY symbol ORDER BY month ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))""", "px")  # fmt: skip
def month_end_trend(v):
    return strategies.month_end_trend(v.px)


@query("month symbol", "", "w", """SELECT month, symbol, CASE WHEN sum(w) OVER m > 2 THEN w * 2 / sum(w) OVER m ELSE w END AS w FROM (
    SELECT *, CASE WHEN sqrt(sum(pow(raw * vol, 2)) OVER m) < 1e-8 THEN 0 ELSE least(raw * 0.1 / sqrt(sum(pow(raw * vol, 2)) OVER m), 0.15) END AS w FROM (
      SELECT symbol, CAST(date_trunc('month', dt) AS DATE) AS month, vol, CASE WHEN rise > 0 THEN 1 / vol ELSE 0 END AS raw FROM (
        SELECT *, CASE WHEN count(ret) OVER k >= 60 THEN greatest(stddev_samp(ret) OVER k * sqrt(252), 0.02) END AS vol, price / lag(price, 252) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS rise,
          row_number() OVER (PARTITION BY symbol, date_trunc('month', dt) ORDER BY dt DESC) AS nth FROM pr WINDOW k AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))
      WHERE nth = 1 AND rise IS NOT NULL AND vol IS NOT NULL) WINDOW m AS (PARTITION BY month)) WINDOW m AS (PARTITION BY month)""", "px pr", places=6)  # fmt: skip
def momentum_weights(v):
    return strategies.momentum_weights(v.px)


@query("symbol dt", "", "w", """SELECT symbol, dt, coalesce(last_value(e IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt), 0) AS w FROM (SELECT symbol, dt,
    CASE WHEN count(*) OVER a >= 20 AND price > max(price) OVER a THEN 1.0 WHEN count(*) OVER b >= 10 AND price < min(price) OVER b THEN 0.0 END AS e FROM px
    WINDOW a AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))""", "px")  # fmt: skip
def channel_breakout(v):
    return strategies.channel_breakout(v.px)


@query("symbol session bar", "", "side", """SELECT symbol, session, bar, last_value(e IGNORE NULLS) OVER (PARTITION BY symbol, session ORDER BY bar) AS side FROM (
    SELECT *, CASE WHEN abs(gap) > 5 THEN sign(gap) WHEN k = 1 THEN CASE WHEN gap >= 0 THEN 1 ELSE -1 END END AS e FROM (SELECT *, round(close - sum((high + low + close) / 3 * volume) OVER w / sum(volume) OVER w, 9) AS gap, row_number() OVER w AS k FROM bars WINDOW w AS (PARTITION BY symbol, session ORDER BY bar)))""", "ticks bars")  # fmt: skip
def vwap_side(v):
    d = panel.session_vwap(v.bars)
    # rounded, so that a gap of nothing has one sign everywhere
    return strategies.banded_side(d.withColumn("vwap", F.col("close") - F.round(F.col("close") - F.col("vwap"), 9)), 5.0)


@query("symbol session", "", "r", f"""SELECT symbol, session, CASE WHEN prior < 0.2 AND n >= 5 THEN close / open - 1 - 0.0002 ELSE 0 END AS r FROM (
    SELECT *, lag((close - low) / nullif(high - low, 0)) OVER (PARTITION BY symbol ORDER BY session) AS prior FROM {_SESSIONS})""", "ticks bars")  # fmt: skip
def close_strength_reversion(v):
    return strategies.close_strength_reversion(v.bars)


@query("symbol session", "", "r", f"""SELECT symbol, session, CASE WHEN late < 0 AND fill IS NOT NULL THEN fill / close - 1 - 0.0002 ELSE 0 END AS r FROM (
    SELECT *, lead(second_open) OVER (PARTITION BY symbol ORDER BY session) AS fill FROM {_SESSIONS} LEFT JOIN (SELECT symbol, session, arg_max(close, bar) / arg_min(close, bar) - 1 AS late FROM bars WHERE hour(bar) >= 22 GROUP BY 1, 2) USING (symbol, session))""", "ticks bars")  # fmt: skip
def overnight_reversal(v):
    return strategies.overnight_reversal(v.bars)


@query("dt", "", "r", """SELECT dt, CASE WHEN n >= 7 AND rn > n - 5 AND side <> 0 THEN side * ret - 0.0001 ELSE 0 END AS r FROM (
    SELECT *, -sign(max(CASE WHEN rn = n - 5 THEN s END) OVER m / max(CASE WHEN rn = 1 THEN s END) OVER m - max(CASE WHEN rn = n - 5 THEN b END) OVER m / max(CASE WHEN rn = 1 THEN b END) OVER m) AS side FROM (
      SELECT *, row_number() OVER (PARTITION BY date_trunc('month', dt) ORDER BY dt) AS rn, count(*) OVER (PARTITION BY date_trunc('month', dt)) AS n, s / lag(s) OVER (ORDER BY dt) - 1 AS ret FROM (
        SELECT dt, max(CASE WHEN symbol = '1-URGENT' THEN price END) AS s, max(CASE WHEN symbol = '5-LOW' THEN price END) AS b FROM px GROUP BY dt) WHERE s IS NOT NULL AND b IS NOT NULL)
    WINDOW m AS (PARTITION BY date_trunc('month', dt)))""", "px")  # fmt: skip
def month_end_flow(v):
    one = lambda k: F.max(F.when(F.col("symbol") == k, F.col("price")))
    wide = v.px.groupBy("dt").agg(one("1-URGENT").alias("s"), one("5-LOW").alias("b")).where("s is not null and b is not null")
    return strategies.month_end_flow(wide, "s", "b")


def _graded(w):
    out = simulate.core_metrics(simulate.simulate_weights(w.withColumn("run_id", F.col("symbol"))))
    return out.withColumnRenamed("run_id", "symbol")


def _grade(ctes: str) -> str:
    """Metrics of the weights of `rule` (symbol, dt, price, w), simulated with costs of ten basis points."""
    return f"""WITH RECURSIVE n AS (SELECT symbol, dt, price, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS i FROM px), {ctes},
    sim AS (SELECT symbol, dt, held * (price / prev - 1) - 0.001 * abs(w - held) AS r FROM (SELECT *, lag(w) OVER o AS held, lag(price) OVER o AS prev FROM rule WINDOW o AS (PARTITION BY symbol ORDER BY dt)) WHERE prev IS NOT NULL),
    eq AS (SELECT symbol, dt, r, sum(ln(1 + r)) OVER (PARTITION BY symbol ORDER BY dt) AS le FROM sim), dd AS (SELECT symbol, r, le - max(le) OVER (PARTITION BY symbol ORDER BY dt) AS d FROM eq)
    SELECT symbol, count(*) AS n, coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) * sqrt(252) AS sharpe, exp(min(d)) - 1 AS max_drawdown FROM dd GROUP BY 1"""


_CROSSED = _grade("""e AS (SELECT symbol, i, price AS q, price AS c FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, q + 2 / 21e0 * (price - q), c + 2 / 51e0 * (price - c) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1),
    s AS (SELECT n.*, CASE WHEN q > c THEN 1 ELSE -1 END AS ld, CASE WHEN count(*) OVER k < 100 THEN 0 WHEN price > avg(price) OVER k THEN 1 ELSE -1 END AS macro FROM n JOIN e USING (symbol, i) WINDOW k AS (PARTITION BY symbol ORDER BY n.i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)),
    t AS (SELECT *, ld <> lag(ld) OVER o AS crossed, macro = -lag(macro) OVER o AS turned FROM s WINDOW o AS (PARTITION BY symbol ORDER BY i)),
    rule AS (SELECT symbol, dt, price, coalesce(last_value(CASE WHEN macro = 1 AND ld = 1 AND (crossed OR turned) THEN 1.0e0 WHEN crossed IS NOT NULL AND (macro = -1 OR (crossed AND ld = -1)) THEN 0.0e0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i), 0) AS w FROM t)""")  # fmt: skip
_EXTREME = _grade("""d AS (SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY i) - 1 AS d FROM n),
    z AS (SELECT symbol, dt, price, i, (lag(d) OVER o - avg(d) OVER k) / nullif(stddev_samp(d) OVER k, 0) AS z, CASE WHEN count(*) OVER m >= 50 THEN avg(price) OVER m END AS mean FROM d
          WINDOW o AS (PARTITION BY symbol ORDER BY i), k AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING), m AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
    rule AS (SELECT symbol, dt, price, i, 0.0e0 AS w FROM z WHERE i = 1 UNION ALL SELECT z.symbol, z.dt, z.price, z.i, CASE WHEN z IS NULL OR mean IS NULL THEN w WHEN w = 0 THEN CASE WHEN z >= 2 AND z.price > mean THEN -1 WHEN z <= -2 AND z.price <= mean THEN 1 ELSE 0 END WHEN abs(z) <= 0.5 THEN 0 ELSE w END
      FROM rule JOIN z ON z.symbol = rule.symbol AND z.i = rule.i + 1)""")  # fmt: skip
_SOLD = _grade("""d AS (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY i) AS d, CASE WHEN count(*) OVER m >= 200 THEN avg(price) OVER m END AS mean FROM n WINDOW m AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)),
    e AS (SELECT symbol, i, greatest(d, 0) AS g, greatest(-d, 0) AS l FROM d WHERE i = 2 UNION ALL SELECT d.symbol, d.i, g / 2 + greatest(d, 0) / 2, l / 2 + greatest(-d, 0) / 2 FROM e JOIN d ON d.symbol = e.symbol AND d.i = e.i + 1),
    x AS (SELECT d.symbol, d.dt, d.price, d.i, mean, CASE WHEN i >= 3 AND g + l > 0 THEN 100 * g / (g + l) END AS rsi FROM d LEFT JOIN e USING (symbol, i)),
    rule AS (SELECT symbol, dt, price, coalesce(last_value(CASE WHEN rsi < 10 AND price > mean THEN 1.0e0 WHEN rsi > 70 THEN 0.0e0 END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY i), 0) AS w FROM x)""")  # fmt: skip
_ADX = """WITH RECURSIVE b AS (SELECT symbol, bar, row_number() OVER w AS i, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS span, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY bar)),
    m AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS q FROM b),
    e AS (SELECT symbol, i, CAST(span AS DOUBLE) AS atr, CAST(p AS DOUBLE) AS p, CAST(q AS DOUBLE) AS q FROM m WHERE i = 1 UNION ALL SELECT m.symbol, m.i, atr * 13 / 14 + span / 14, e.p * 13 / 14 + m.p / 14, e.q * 13 / 14 + m.q / 14 FROM e JOIN m ON m.symbol = e.symbol AND m.i = e.i + 1),
    dx AS (SELECT symbol, i, 100 * abs(100 * p / atr - 100 * q / atr) / nullif(100 * p / atr + 100 * q / atr, 0) AS dx FROM e WHERE i >= 14),
    a AS (SELECT symbol, i, dx AS adx FROM dx WHERE i = 14 UNION ALL SELECT dx.symbol, dx.i, adx * 13 / 14 + dx / 14 FROM a JOIN dx ON dx.symbol = a.symbol AND dx.i = a.i + 1)
    SELECT symbol, bar, CASE WHEN i >= 27 THEN adx END AS adx FROM b LEFT JOIN a USING (symbol, i)"""


@query("symbol", "n", "sharpe max_drawdown", _CROSSED, "px", places=6)
def dual_ema(v):
    return _graded(strategies.dual_ema(v.px))


@query("symbol", "n", "sharpe max_drawdown", None)
def squeeze_breakout(v):
    return _graded(strategies.squeeze_breakout(v.px))


@query("symbol", "n", "sharpe max_drawdown", _EXTREME, "px", places=6)
def extreme_reversion(v):
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(-30, -1)
    d = panel.pct_change("price", panel.along("symbol"))
    z = v.px.withColumn("d", d).withColumn("z", F.try_divide(F.lag("d").over(panel.along("symbol")) - F.avg("d").over(w), F.stddev_samp("d").over(w)))
    return _graded(strategies.extreme_reversion(z))


@query("symbol", "n", "sharpe max_drawdown", _SOLD, "px", places=6)
def oversold(v):
    return _graded(strategies.oversold(v.px))


@query("symbol bar", "", "adx", _ADX, "ticks bars", places=6)
def directional_index(v):
    return strategies.directional_index(v.bars)


#: what a session knows of those before it, and how its bars lie; WITH RECURSIVE goes before
_BEFORE = """ss AS (SELECT symbol, session, max(high) AS high, min(low) AS low, arg_max(close, bar) AS close, count(*) AS bars, row_number() OVER (PARTITION BY symbol ORDER BY session) AS i FROM bars GROUP BY 1, 2),
    tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) OVER w), 0), coalesce(abs(low - lag(close) OVER w), 0)) AS tr FROM ss WINDOW w AS (PARTITION BY symbol ORDER BY session)),
    av AS (SELECT symbol, i, CAST(tr AS DOUBLE) AS atr FROM tr WHERE i = 1 UNION ALL SELECT tr.symbol, tr.i, atr * 13 / 14 + tr / 14 FROM av JOIN tr ON tr.symbol = av.symbol AND tr.i = av.i + 1),
    bf AS (SELECT tr.symbol, tr.session, p.high AS prior_high, p.low AS prior_low, CASE WHEN tr.i > 14 THEN atr END AS atr FROM tr LEFT JOIN ss AS p ON p.symbol = tr.symbol AND p.i = tr.i - 1 LEFT JOIN av ON av.symbol = tr.symbol AND av.i = tr.i - 1),
    vw AS (SELECT *, row_number() OVER w AS k, close - vwap AS off, stddev_samp(close - vwap) OVER w AS band FROM (SELECT *, sum((high + low + close) / 3 * volume) OVER v / sum(volume) OVER v AS vwap FROM bars WINDOW v AS (PARTITION BY symbol, session ORDER BY bar)) WINDOW w AS (PARTITION BY symbol, session ORDER BY bar))"""
_TOLD = "SELECT bf.symbol, bf.session, CAST(outcome IS NOT NULL AS INT) AS entries, coalesce(side, 0) AS side, coalesce(outcome, 'no_entry') AS outcome, coalesce(pnl, 0) AS pnl, coalesce(worst, 0) AS worst FROM bf LEFT JOIN touched USING (symbol, session)"


def _fade(first: int) -> str:
    return f"""WITH RECURSIVE {_BEFORE}, op AS (SELECT *, greatest(count(*) FILTER (epoch(bar) - epoch(begin) <= 7200) OVER o, {first + 1}) AS last FROM (SELECT *, row_number() OVER (o ORDER BY bar) AS k, count(*) OVER o AS n, min(bar) OVER o AS begin, first(open) OVER (o ORDER BY bar) AS opened FROM bars WINDOW o AS (PARTITION BY symbol, session)) WINDOW o AS (PARTITION BY symbol, session)),
    e AS (SELECT symbol, session, bar, close AS entry, side, close - abs(close - opened) * side AS stop, close + abs(close - opened) * 1.5e0 * side AS target FROM (SELECT *, CASE WHEN close > opened THEN -1 ELSE 1 END AS side FROM op JOIN bf USING (symbol, session) WHERE k = last AND last < n AND n >= 5 AND atr > 0 AND abs(close - opened) >= 0.2e0 * atr)),
    {TOUCHED}"""


@query("symbol session outcome", "entries side", "pnl worst", f"{_fade(0)} {_TOLD}", "ticks bars")
def opening_fade(v):
    return session_trades.opening_fade(v.bars, minutes=120, least=0.2)


@query("symbol session outcome", "entries side", "pnl worst", f"""WITH RECURSIVE {_BEFORE}, ax AS ({_ADX}),
    e AS (SELECT symbol, session, bar, close AS entry, side, close - 0.5e0 * atr * side AS stop, close + 0.5e0 * atr * 1.5e0 * side AS target FROM (SELECT *, CASE WHEN high >= prior_high AND off >= 0.5e0 * band THEN -1 WHEN low <= prior_low AND off <= -0.5e0 * band THEN 1 END AS side FROM (
      SELECT vw.*, bf.atr, bf.prior_high, bf.prior_low, adx, lag(adx, 2) OVER (PARTITION BY vw.symbol, vw.session ORDER BY vw.bar) AS was FROM vw JOIN bf USING (symbol, session) JOIN ax ON ax.symbol = vw.symbol AND ax.bar = vw.bar) WHERE k > 2 AND was >= 8 AND adx < was AND band > 0 AND atr > 0 AND prior_high IS NOT NULL)
      WHERE side IS NOT NULL QUALIFY row_number() OVER (PARTITION BY symbol, session ORDER BY bar) = 1), {TOUCHED} {_TOLD}""", "ticks bars")  # fmt: skip
def tired_trend(v):
    return session_trades.tired_trend(v.bars, back=2, strong=8.0, stretch=0.5)


_REGIME = "SELECT symbol, session, CASE WHEN avg(CASE WHEN band > 0 THEN abs(off / band) END) IS NULL THEN -1 WHEN avg(CASE WHEN band > 0 THEN abs(off / band) END) >= 1 THEN 1 ELSE 0 END AS regime FROM vw WHERE k <= 6 GROUP BY 1, 2"


@query("symbol session", "regime", "", f"WITH RECURSIVE {_BEFORE} {_REGIME}", "ticks bars")
def session_regime(v):
    return session_trades.session_regime(v.bars, stretch=1.0, first=6)


@query("symbol session", "regime entries", "pnl worst", f"{_fade(6)}, told AS ({_TOLD}), rg AS ({_REGIME}) SELECT symbol, session, regime, CASE WHEN regime = 0 THEN entries ELSE 0 END AS entries, CASE WHEN regime = 0 THEN pnl ELSE 0 END AS pnl, CASE WHEN regime = 0 THEN worst ELSE 0 END AS worst FROM told JOIN rg USING (symbol, session)", "ticks bars")
def routed_sessions(v):
    return session_trades.routed(v.bars, stretch=1.0, first=6, minutes=120, least=0.2)
