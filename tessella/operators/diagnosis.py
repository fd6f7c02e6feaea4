"""Structural breaks, predictive ability, scenario response, label weights, look-ahead and audit checks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.functions import stats

from .blocks import digest
from .panel import along

#: Critical values of the Brownian bridge's supremum by confidence.
BRIDGE = {0.90: 1.22, 0.95: 1.36, 0.99: 1.63}


def cusum(returns: DataFrame, key: str = "run_id", confidence: float = 0.95) -> DataFrame:
    """Breaks in mean (sup of the scaled bridge) and in variance (sup of the cumulated squares' share less the elapsed share)."""
    all_, w = Window.partitionBy(key), along(key).rowsBetween(Window.unboundedPreceding, 0)
    r = F.col("r")
    d = returns.withColumn("n", F.count("*").over(all_)).withColumn("i", F.row_number().over(along(key)))
    d = d.withColumn("d", r - F.avg("r").over(all_)).withColumn("sd", F.stddev_samp("r").over(all_)).withColumn("q", F.sum(r * r).over(all_))
    d = d.withColumn("bridge", F.abs(F.sum("d").over(w)) / (F.col("sd") * F.sqrt("n"))).withColumn("share", F.abs(F.sum(r * r).over(w) / F.col("q") - F.col("i") / F.col("n")))
    out = d.groupBy(key).agg(F.max("n").alias("n"), F.max("bridge").alias("mean_sup"), F.max_by("dt", "bridge").alias("mean_at"), F.max("share").alias("variance_sup"), F.max_by("dt", "share").alias("variance_at"))
    return out.withColumn("mean_break", F.col("mean_sup") > BRIDGE[confidence]).withColumn("variance_break", F.col("variance_sup") > 0.1 + 0.85 / F.sqrt("n"))


def edge_decay(returns: DataFrame, key: str = "run_id", window: int = 252, ppy: float = m.PPY) -> DataFrame:
    """Slope a year of the Sharpe over windows that start every window / 4 rows; runs of fewer than two windows are left out."""
    w = along(key)
    ahead = w.rowsBetween(0, window - 1)
    sd = F.stddev_samp("r").over(ahead)
    d = returns.withColumn("n", F.count("*").over(Window.partitionBy(key))).withColumn("i", F.row_number().over(w) - 1)
    d = d.withColumn("s", F.when(sd > 0, F.avg("r").over(ahead) / sd * F.sqrt(F.lit(float(ppy)))).otherwise(0.0))
    d = d.where((F.col("i") % max(1, window // 4) == 0) & (F.col("i") <= F.col("n") - window) & (F.col("n") >= 2 * window))
    return d.groupBy(key).agg(F.count("*").alias("windows"), (F.regr_slope("s", F.col("i") + window // 2) * ppy).alias("slope_annual")).where("windows >= 3").withColumn("decays", F.col("slope_annual") < -0.1)


def diebold_mariano(losses: DataFrame, a: str, b: str) -> DataFrame:
    """One row: mean loss difference, one-step statistic with the small-sample factor, and its p-value."""
    d = F.col(a) - F.col(b)
    n = F.count("*")
    out = losses.agg(n.alias("n"), F.avg(d).alias("mean_difference"), (F.avg(d) / F.sqrt(F.var_pop(d) / n) * F.sqrt((n - 1) / n)).alias("statistic"))
    return out.withColumn("p_value", 2 * stats.student_t_sf_udf(F.abs("statistic"), (F.col("n") - 1).cast("double")))


def giacomini_white(losses: DataFrame, key: str, a: str, b: str, instruments: list[str]) -> DataFrame:
    """(key, n, statistic, p_value, different): whether the instruments tell when the losses `a` and `b` differ.

    The Wald statistic of the mean of each instrument times the difference, chi-square with as many degrees. Sums of products are
    taken in Spark; only these few numbers a key are solved. Rows with a null take no part; keys of under five rows an
    instrument: statistic 0, p 1.
    """
    q = len(instruments)
    d = losses.dropna(subset=[a, b, *instruments])
    z = [F.col(h) * (F.col(a) - F.col(b)) for h in instruments]
    d = d.groupBy(key).agg(F.count("*").alias("n"), F.array(*[F.avg(x) for x in z]).alias("mean"), F.array(*[F.covar_samp(x, y) for x in z for y in z]).alias("cov"))

    def solve(frames):
        for p in frames:
            out = []
            for n, mean, cov in zip(p["n"], p["mean"], p["cov"]):
                mean = np.array(mean, float)
                out.append(float(n * mean @ np.linalg.pinv(np.array(cov, float).reshape(q, q)) @ mean) if n >= 5 * q else 0.0)
            yield p[[key, "n"]].assign(statistic=out)

    out = d.mapInPandas(solve, f"{key} {losses.schema[key].dataType.simpleString()}, n long, statistic double")
    p = F.when(F.col("n") >= 5 * q, stats.chi2_sf_of("statistic", q)).otherwise(1.0)
    return out.withColumn("p_value", p).withColumn("different", F.col("p_value") < 0.05)


def pesaran_timmermann(df: DataFrame, key: str, guess: str, actual: str) -> DataFrame:
    """Per key: the share of right signs, the share under independence, and the statistic."""
    up = lambda c: (F.col(c) > 0).cast("double")
    d = df.where(F.col(guess).isNotNull() & F.col(actual).isNotNull())
    d = d.groupBy(key).agg(F.count("*").alias("n"), F.avg(up(actual)).alias("p"), F.avg(up(guess)).alias("q"), F.avg((up(guess) == up(actual)).cast("double")).alias("hit_rate"))
    n, p, q = F.col("n"), F.col("p"), F.col("q")
    e = F.col("expected")
    var = e * (1 - e) / n - (F.pow(2 * p - 1, 2) * q * (1 - q) + F.pow(2 * q - 1, 2) * p * (1 - p)) / n - 4 * p * q * (1 - p) * (1 - q) / (n * n)
    d = d.withColumn("expected", p * q + (1 - p) * (1 - q)).withColumn("var", var)
    return d.withColumn("statistic", F.when((n >= 30) & (F.col("var") > 0), (F.col("hit_rate") - e) / F.sqrt("var")).otherwise(0.0)).drop("var", "p", "q")


def dominance(returns: DataFrame, a: str, b: str, order: int = 2, points: int = 80, key: str = "run_id") -> DataFrame:
    """One row: the largest studentised excess of the dominance integrals of `a` over `b` and of `b` over `a` on an even grid."""
    two = returns.where(F.col(key).isin(a, b)).select(key, "r")
    ends = two.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    grid = ends.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("g"), "lo", "hi")
    grid = grid.select("g", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("g") / (points - 1)).alias("x"))
    # `points` rows, whatever the input
    d = two.crossJoin(F.broadcast(grid))
    short = F.greatest(F.col("x") - F.col("r"), F.lit(0.0))
    value = (F.col("r") < F.col("x")).cast("double") if order == 1 else short if order == 2 else short * short / 2
    d = d.groupBy(key, "g").agg(F.avg(value).alias("d"), (F.var_pop(value) / F.count("*")).alias("v"))
    one = lambda k, c: F.max(F.when(F.col(key) == k, F.col(c)))
    d = d.groupBy("g").agg(one(a, "d").alias("da"), one(b, "d").alias("db"), one(a, "v").alias("va"), one(b, "v").alias("vb"))
    t = (F.col("da") - F.col("db")) / F.sqrt(F.greatest(F.col("va") + F.col("vb"), F.lit(1e-12)))
    return d.agg(F.max(t).alias("t_dominates"), F.max(-t).alias("t_dominated"))


def drawdown_response(wide: DataFrame, y: str, x: str, thresholds: tuple[float, ...] = (0.05, 0.1, 0.2)) -> DataFrame:
    """(threshold, n, mean, hit_rate, beta) of y on the days on which x's equity is that far below its peak."""
    # one benchmark is one ordered sequence
    w = Window.partitionBy(F.lit(1)).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    d = wide.withColumn("_e", F.sum(F.log1p(x)).over(w))
    d = d.withColumn("_d", F.expm1(F.col("_e") - F.greatest(F.max("_e").over(w), F.lit(0.0))))
    d = d.withColumn("threshold", F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("_d") <= -t)))
    return d.groupBy("threshold").agg(F.count("*").alias("n"), F.avg(y).alias("mean"), F.avg((F.col(y) > 0).cast("double")).alias("hit_rate"), F.regr_slope(y, x).alias("beta"))


def calm_and_stress_correlation(wide: DataFrame, y: str, x: str, quantile: float = 0.1) -> DataFrame:
    """Correlation of y and x on the days on which x is in its lowest part, on the others, and the change."""
    q = wide.agg(F.percentile(x, F.lit(quantile)).alias("q"))
    stress = F.col(x) <= F.col("q")
    part = lambda on: F.corr(F.when(on, F.col(y)), F.when(on, F.col(x)))
    return wide.crossJoin(F.broadcast(q)).agg(F.count_if(stress).alias("n_stress"), part(stress).alias("stress"), part(~stress).alias("calm")).withColumn("change", F.col("stress") - F.col("calm"))


def lifecycle(returns: DataFrame, key: str = "run_id", ppy: int = m.PPY) -> DataFrame:
    """Sharpe of all rows, of the first third (a year at least) and of the last two years, and the phase that they show."""
    n, i = F.count("r").over(Window.partitionBy(key)), F.row_number().over(along(key)) - 1
    d = returns.where("r is not null").withColumn("n", n).withColumn("i", i)
    ratio = lambda on: F.try_divide(F.avg(F.when(on, F.col("r"))), F.stddev_samp(F.when(on, F.col("r")))) * F.sqrt(F.lit(float(ppy)))
    d = d.groupBy(key, "n").agg(ratio(F.lit(True)).alias("whole"), ratio(F.col("i") < F.greatest(F.lit(ppy), F.floor(F.col("n") / 3))).alias("early"), ratio(F.col("i") >= F.col("n") - 2 * ppy).alias("late"))
    rising, falling = F.coalesce(F.col("late") > F.col("early") + 0.2, F.lit(False)), F.coalesce(F.col("late") < F.col("early") - 0.2, F.lit(False))
    phase = F.when(F.col("n") < ppy, "INSUFFICIENT_DATA").when((F.col("n") < 4 * ppy) & ~falling, "EMERGENCE").when(rising, "EXPLOITATION").when(falling, "DECLINE").otherwise("MATURITY")
    return d.withColumn("phase", phase).withColumn("late_share", F.try_divide("late", "whole"))


def meta_labels(signals: DataFrame, signal: str, horizon: int = 1) -> DataFrame:
    """1 where the signal's sign is the sign of the return `horizon` bars ahead, else 0; null without that bar."""
    ahead = F.lead("ret", horizon).over(along("symbol"))
    return signals.withColumn("label", F.when(ahead.isNotNull() & F.col(signal).isNotNull(), (F.signum(signal) == F.signum(ahead)).cast("int")))


def uniqueness(events: DataFrame, prices: DataFrame, bars: int = 20) -> DataFrame:
    """(symbol, dt, weight): mean of 1 / concurrency over a label's span, scaled to sum to the number of events.

    Concurrency is a running sum of starts less ends and the mean is a difference of two running sums, so no span is
    joined with the bars that it covers.
    """
    w = along("symbol")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    p = prices.select("symbol", "dt").join(events.select("symbol", "dt").distinct().withColumn("hit", F.lit(1)), ["symbol", "dt"], "left")
    p = p.withColumn("i", F.row_number().over(w)).withColumn("hit", F.coalesce("hit", F.lit(0)))
    p = p.withColumn("live", F.sum("hit").over(w.rowsBetween(-bars, 0)))
    p = p.withColumn("total", F.sum(1.0 / F.greatest("live", F.lit(1))).over(up))
    last = w.rowsBetween(0, bars)
    p = p.withColumn("to_total", F.last("total").over(last)).withColumn("to_i", F.last("i").over(last))
    p = p.withColumn("mean", (F.col("to_total") - F.col("total") + 1.0 / F.greatest("live", F.lit(1))) / (F.col("to_i") - F.col("i") + 1)).where("hit = 1")
    all_ = Window.partitionBy("symbol")
    return p.select("symbol", "dt", (F.col("mean") / F.sum("mean").over(all_) * F.count("*").over(all_)).alias("weight"))


def lookahead(rule, prices: DataFrame, at: float = 0.5, seed: int = 7, tolerance: float = 1e-9) -> DataFrame:
    """Per symbol: how far rule(prices) before a cutoff changes when the prices after it are scrambled.

    The rule runs twice; its weights are compared by a full outer join. A weight on one side alone is an infinite change.
    """
    n, i = F.count("*").over(Window.partitionBy("symbol")), F.row_number().over(along("symbol"))
    p = prices.withColumn("_late", i > F.floor(n * at))
    noise = digest(F.lit(seed), "symbol", F.col("dt").cast("string")) % 10_000 / 10_000.0
    after = p.withColumn("price", F.when(F.col("_late"), F.col("price") * (0.5 + noise)).otherwise(F.col("price")))
    cut = p.where("not _late").groupBy("symbol").agg(F.max("dt").alias("cutoff"))
    one, two = (rule(x.drop("_late")).select("symbol", "dt", F.col("w").alias(k)) for x, k in ((p, "a"), (after, "b")))
    both = one.join(two, ["symbol", "dt"], "full_outer").join(cut, "symbol").where("dt <= cutoff")
    gap = F.when(F.col("a").eqNullSafe(F.col("b")), 0.0).when(F.col("a").isNull() | F.col("b").isNull(), float("inf")).otherwise(F.abs(F.col("a") - F.col("b")))
    return both.groupBy("symbol").agg(F.count("*").alias("n"), F.max(gap).alias("change")).withColumn("leaks", F.col("change") > tolerance)


def twins(returns: DataFrame, key: str = "run_id", overlap: int = 50, share: float = 0.99, correlation: float = 0.999) -> DataFrame:
    """Pairs of runs that are one and the same: nearly all common returns equal, or correlated above the bound."""
    a, b = (returns.select("dt", F.col(key).alias(f"{k}_id"), F.col("r").alias(k)) for k in "ab")
    d = a.join(b, "dt").where("a_id < b_id").groupBy("a_id", "b_id").agg(
        F.count("*").alias("n"), F.avg((F.abs(F.col("a") - F.col("b")) <= 1e-12).cast("double")).alias("equal"), F.corr("a", "b").alias("corr"))
    return d.where(F.col("n") >= overlap).withColumn("finding", F.when(F.col("equal") >= share, "identical").when(F.col("corr") > correlation, "correlated"))


def regression_diff(old: DataFrame, new: DataFrame, tolerances: dict[str, float], key: str = "run_id") -> DataFrame:
    """(key, metric, old, new, status): REGRESSION, IMPROVEMENT, UNCHANGED, ADDED or REMOVED; larger is better."""
    long = lambda df, name: df.unpivot([key], list(tolerances), "metric", name)
    d = long(old, "old").join(long(new, "new"), [key, "metric"], "full_outer")
    tol = F.element_at(F.create_map(*[F.lit(x) for kv in tolerances.items() for x in kv]), F.col("metric"))
    gap = F.col("new") - F.col("old")
    status = F.when(F.col("old").isNull(), "ADDED").when(F.col("new").isNull(), "REMOVED").when(gap < -tol, "REGRESSION").when(gap > tol, "IMPROVEMENT").otherwise("UNCHANGED")
    return d.withColumn("status", status)


def decimate(returns: DataFrame, points: int = 800, key: str = "run_id") -> DataFrame:
    """At most about `points` evenly spaced rows a run, both ends kept."""
    n, i = F.count("*").over(Window.partitionBy(key)), F.row_number().over(along(key)) - 1
    bucket = lambda x: F.floor(x * (points - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    d = returns.withColumn("_n", n).withColumn("_i", i)
    return d.where((F.col("_n") <= points) | (F.col("_i") == 0) | (bucket(F.col("_i")) != bucket(F.col("_i") - 1))).drop("_n", "_i")


def kelly(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """Win rate, payoff ratio, the full and half bet they suggest, and mean over variance."""
    r = F.col("r")
    d = returns.groupBy(key).agg(m.win_rate("r").alias("win_rate"), F.try_divide(F.avg(F.when(r > 0, r)), F.abs(F.avg(F.when(r < 0, r)))).alias("payoff"), F.try_divide(F.avg(r), F.var_samp(r)).alias("continuous"))
    full: Column = F.greatest(F.col("win_rate") - F.try_divide(1 - F.col("win_rate"), F.col("payoff")), F.lit(0.0))
    return d.withColumn("full", full).withColumn("half", F.col("full") / 2)


def spread_bps(adv: Column, price: Column) -> Column:
    return F.when(adv <= 0, 50.0).otherwise(F.least(F.greatest(50 - 5 * F.log10(F.greatest(adv * price, F.lit(1.0))), F.lit(1.0)), F.lit(500.0)))


def impact_bps(size: Column, adv: Column, vol: float = 0.02) -> Column:
    """Square-root impact, at most 500."""
    return F.when((adv <= 0) | (size <= 0), 0.0).otherwise(F.least(vol * F.sqrt(size / adv) * 1e4, F.lit(500.0)))


def cost_levels(returns: DataFrame, turnover: float, levels: tuple[float, ...] = (0, 1, 2, 5, 10, 20, 50, 100), key: str = "run_id", ppy: float = m.PPY) -> DataFrame:
    """(key, bps, net_sharpe): the Sharpe after that cost on `turnover` a year."""
    d = returns.groupBy(key).agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"))
    d = d.withColumn("bps", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    return d.select(key, "bps", F.try_divide(F.col("mu") * ppy - turnover * F.col("bps") / 1e4, F.col("sd") * F.sqrt(F.lit(float(ppy)))).alias("net_sharpe"))


#: Annual rates of margin and, by tier, of borrowing, and the daily hazard of a recall.
MARGIN_RATE = 0.0533
BORROW_RATES = {"easy": 0.005, "general": 0.015, "hard": 0.075, "specials": 0.20}
RECALL_HAZARDS = {"easy": 0.001, "general": 0.003, "hard": 0.015, "specials": 0.05}


def by_tier(tier: Column, values: dict[str, float]) -> Column:
    """The tier's value; an unknown tier counts as general."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[tier], F.lit(values["general"]))


def one_way_bps(size: Column, adv: Column, price: Column, commission: float = 1.0) -> Column:
    """Half the spread, the impact and the commission."""
    return spread_bps(adv, price) / 2 + impact_bps(size, adv) + commission


def financing_drag(short: Column, borrow_bps: Column, leverage: Column) -> Column:
    """Annual drag of borrowing what is short and of margin on what exceeds the capital."""
    return short * borrow_bps / 1e4 + F.greatest(leverage - 1, F.lit(0.0)) * MARGIN_RATE


def recall_risk(days: Column, tier: Column) -> Column:
    """Chance that a short of so many days is recalled."""
    return 1 - F.exp(-by_tier(tier, RECALL_HAZARDS) * F.greatest(days, F.lit(0)))


def most_positions(trade: Column, adv: Column, participation: float = 0.01, most_bps: float = 20.0) -> Column:
    """Positions of that size which the participation and impact bounds allow, one at least; none for empty trades."""
    n = F.greatest(F.floor(adv * participation / trade), F.lit(1))
    impact = impact_bps(adv * participation, adv)
    return F.when(trade <= 0, 0).when(impact > most_bps, F.greatest(F.floor(n * F.pow(most_bps / impact, F.lit(2))), F.lit(1))).otherwise(n)


def capital_scaling(returns: DataFrame, levels: list[float], adv: float = 1e7, key: str = "run_id", ppy: int = m.PPY) -> DataFrame:
    """(key, capital, impact_bps, sharpe): what temporary and permanent impact leave of the Sharpe at every level of capital."""
    d = returns.groupBy(key).agg(m.sharpe("r", ppy).alias("base"), F.stddev_samp("r").alias("sd")).withColumn("capital", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    part = F.least(F.col("capital") / adv, F.lit(1.0))
    d = d.withColumn("impact_bps", F.col("sd") * 0.314 * F.sqrt(part) * 1e4 + 0.1 * part * 1e4)
    return d.withColumn("sharpe", F.greatest(F.col("base") - F.col("impact_bps") / 1e4 * ppy / F.greatest(F.col("sd") * F.sqrt(F.lit(float(ppy))), F.lit(0.01)), F.lit(0.0)))


def periods_per_year(dates: DataFrame, key: str) -> DataFrame:
    """(key, gap, ppy) from the median days between dates: 252 up to two days, 52 up to nine, 12 up to forty-five, else 1."""
    gap = F.date_diff("dt", F.lag("dt").over(along(key)))
    d = dates.withColumn("g", gap).groupBy(key).agg(F.count("*").alias("n"), F.median("g").alias("gap"))
    g = F.col("gap")
    return d.withColumn("ppy", F.when((F.col("n") < 3) | (g <= 2), 252).when(g <= 9, 52).when(g <= 45, 12).otherwise(1))


def sign_permutation(returns: DataFrame, draws: int = 200, key: str = "run_id") -> DataFrame:
    """(key, p_value): how often random signs, digests of (draw, row), give at least the mean seen. Null under 20 rows."""
    d = returns.where("r is not null").select(key, "r", F.row_number().over(along(key)).alias("i"))
    seen = d.groupBy(key).agg(F.avg("r").alias("seen"), F.count("*").alias("n"))
    flip = F.when(F.substring(F.md5(F.concat_ws("-", "draw", "i")), 1, 1) < "8", F.col("r")).otherwise(-F.col("r"))
    d = d.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).groupBy(key, "draw").agg(F.avg(flip).alias("mean")).join(seen, key)
    return d.groupBy(key, "n").agg((F.count_if(F.col("mean") >= F.col("seen")) + 1).alias("hits")).select(key, F.when(F.col("n") >= 20, F.col("hits") / (draws + 1)).alias("p_value"))
