"""Parameter search: grids, selection, holdout, walk-forward, CPCV."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m

from tessella.functions import stats

from .blocks import block_sums, numbered, sharpe_of_sums, whole_units
from .panel import along
from .simulate import core_metrics, simulate_weights
from .validation import sharpe_se


def grid_returns(prices: DataFrame, fast: list[int], cost_bps: float = 10.0) -> DataFrame:
    """Returns of the moving-average rule for every length, from one prefix sum per symbol instead of a window per length."""
    w = along("symbol")
    p = prices.withColumn("rn", F.row_number().over(w)).withColumn("s", F.sum("price").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    lagged = F.array(*[F.struct(F.lit(n).alias("fast"), F.coalesce(F.lag("s", n).over(w), F.lit(0.0)).alias("old")) for n in fast])
    p = p.withColumn("lagged", lagged).withColumn("g", F.explode("lagged")).select("symbol", "dt", "price", "rn", "s", "g.fast", "g.old")
    mean = (F.col("s") - F.col("old")) / F.col("fast")
    p = p.withColumn("w", ((F.col("rn") >= F.col("fast")) & (F.col("price") > mean)).cast("double"))
    p = p.withColumn("run_id", F.struct("fast", "symbol"))
    out = simulate_weights(p, ("run_id",), cost_bps)
    return out.select("run_id.fast", "run_id.symbol", "dt", "r")


def best_combo(returns: DataFrame, combo: str, keys: list[str]) -> DataFrame:
    """The combination of highest Sharpe per key; ties to the smaller combination."""
    s = returns.groupBy(*keys, combo).agg(m.sharpe("r").alias("sharpe"))
    best = F.max(F.struct("sharpe", (-F.col(combo)).alias("neg"))).alias("b")
    return s.groupBy(*keys).agg(best).select(*keys, (-F.col("b.neg")).alias(combo), F.col("b.sharpe").alias("sharpe"))


def robust_choice(returns: DataFrame, combo: str, key: str, sharpe: float = 0.3, psr: float = 0.6, cagr: float = -0.05, max_dd: float = -0.999, ppy: int = m.PPY) -> DataFrame:
    """(key, combo, priority, candidates, ...): of the combinations over all floors, the one of most growth for its activity.

    Growth below zero counts as none and is weighed by log(1 + active bars); ties go to the higher Sharpe, then growth, then
    the smaller combination. A key with no candidate keeps one row, REJECTED, of null combination.
    """
    d = core_metrics(returns, (key, combo), ppy)
    active = returns.groupBy(key, combo).agg(F.count_if(F.col("r") != 0).alias("active"))
    per = F.col("sharpe") / F.sqrt(F.lit(float(ppy)))
    se = sharpe_se(per, F.col("n"), F.col("skewness"), F.col("kurtosis"))
    d = d.join(active, [key, combo]).withColumn("psr", F.when(se > 0, stats.norm_cdf(per / se)).otherwise(0.5))
    good = (F.col("sharpe") >= sharpe) & (F.col("psr") >= psr) & (F.col("cagr") > cagr) & (F.col("max_drawdown") > max_dd)
    rank = F.struct((F.greatest("cagr", F.lit(0.0)) * F.log1p("active")).alias("a"), F.col("sharpe").alias("b"), F.col("cagr").alias("c"), (-F.col(combo)).alias("d"))
    d = d.withColumn("good", good).groupBy(key).agg(F.max(F.when(F.col("good"), F.struct(rank.alias("rank"), F.col(combo), "sharpe", "cagr", "psr"))).alias("best"), F.count_if("good").alias("candidates"))
    return d.select(key, "candidates", F.when(F.col("candidates") > 0, "ROBUST_PERF").otherwise("REJECTED").alias("priority"), *[F.col(f"best.{x}").alias(x) for x in (combo, "sharpe", "cagr", "psr")])


def holdout(returns: DataFrame, key: str = "run_id", ends: tuple[float, float] = (0.6, 0.8), ppy: int = m.PPY) -> DataFrame:
    """Sharpe before, between and after the two cuts; degraded where the last is negative or under 0.3 of a positive middle.

    Keys of 50 rows or fewer are left out.
    """
    n, i = F.count("*").over(Window.partitionBy(key)), F.row_number().over(along(key)) - 1
    d = returns.where("r is not null").withColumn("n", n).withColumn("i", i).where("n > 50")
    first, second = (F.floor(F.col("n") * x) for x in ends)
    part = F.when(F.col("i") < first, 0).when(F.col("i") < second, 1).otherwise(2)
    d = d.withColumn("part", part).groupBy(key).agg(*[m.sharpe(F.when(F.col("part") == k, F.col("r")), ppy).alias(x) for k, x in enumerate(("is_sharpe", "oos_sharpe", "hold_sharpe"))], *[F.count_if(F.col("part") == k).alias(x) for k, x in enumerate(("is_n", "oos_n", "hold_n"))])
    return d.withColumn("degraded", (F.col("hold_sharpe") < 0) | ((F.col("oos_sharpe") > 0) & (F.col("hold_sharpe") < 0.3 * F.col("oos_sharpe"))))


def cpcv_sharpes(returns: DataFrame, combo: str, keys: list[str], groups: int = 10, test_groups: int = 2, purge: int = 0, embargo: int = 0, ppy: int = m.PPY) -> DataFrame:
    """(keys, split, combo, ins, out): every combination's Sharpe in and out of sample, over all choices of test groups.

    A split is a few runs of bars: its test groups, and what lies between them less `purge` bars before each test group and
    the more of purge and embargo after it, however long these are and wherever they meet. Prefix sums give a run's sums as
    two rows, so no split scans bars; they are exact, so combinations with the same returns in a split tie there. Splits of under two bars on either side are left out. Every combination of a key has
    the same bars.
    """
    after, edges = max(purge, embargo), []
    for i, test in enumerate(itertools.combinations(range(groups), test_groups)):
        edges += [(2 * i, k, 0, k + 1, 0) for k in test]
        ends, starts = [(0, 0), *((k + 1, after) for k in test)], [*((k, -purge) for k in test), (groups, 0)]
        edges += [(2 * i + 1, *lo, *hi) for lo, hi in zip(ends, starts)]
    rows, sizes = whole_units(numbered(returns.withColumn("r", m.finite("r")).where("r is not null"), [*keys, combo]).select(*keys, combo, "i", "r"), keys)
    table = F.broadcast(returns.sparkSession.createDataFrame(edges, "draw int, a int, da int, b int, db int"))  # groups and test_groups fix its rows
    at = lambda g, d: F.floor(F.col(g) * F.col("n") / groups) + F.col(d)
    runs = sizes.where(F.col("n") >= groups).crossJoin(table).select(*keys, "n", "draw", at("a", "da").alias("start"), (at("b", "db") - at("a", "da")).alias("len"))
    t = block_sums(rows, keys, ["r", "q", "bars"], runs.where("len > 0"), [combo])
    t = t.where("bars >= 2").join(sizes.drop("n"), keys).select(*keys, combo, F.floor(F.col("draw") / 2).cast("int").alias("split"), (F.col("draw") % 2 == 0).alias("test"), sharpe_of_sums(ppy).alias("sharpe"))
    t = t.groupBy(*keys, "split", combo).agg(F.max(F.when(~F.col("test"), F.col("sharpe"))).alias("ins"), F.max(F.when(F.col("test"), F.col("sharpe"))).alias("out"))
    return t.where("ins is not null and out is not null")


def cpcv_pbo(returns: DataFrame, combo: str, keys: list[str], groups: int = 10, test_groups: int = 2, purge: int = 0, embargo: int = 0, ppy: int = m.PPY) -> DataFrame:
    """Probability of backtest overfitting over all choices of test groups, with what the in-sample winners earn out of sample.

    A winner's rank counts ties as wins and lies half a step lower, so that it never reaches one; ties in sample go to the
    smaller combination. See `cpcv_sharpes` for purge and embargo.
    """
    t = cpcv_sharpes(returns, combo, keys, groups, test_groups, purge, embargo, ppy)
    w = Window.partitionBy(*keys, "split")
    t = t.withColumn("best", F.max(F.struct("ins", (-F.col(combo)).alias("c"), "out")).over(w)).withColumn("m", F.count("*").over(w))
    s = t.groupBy(*keys, "split").agg(((F.count_if(F.col("out") <= F.col("best.out")) - 0.5) / F.first("m")).alias("rank"), F.first("best.ins").alias("ins"), F.first("best.out").alias("out"))
    d = s.groupBy(*keys).agg(F.avg((F.col("rank") < 0.5).cast("double")).alias("pbo"), F.count("*").alias("splits"), F.avg("ins").alias("mean_is"), F.avg("out").alias("mean_oos"))
    half = 1.96 * F.sqrt(F.col("pbo") * (1 - F.col("pbo")) / F.col("splits"))
    d = d.withColumn("pbo_low", F.greatest(F.col("pbo") - half, F.lit(0.0))).withColumn("pbo_high", F.least(F.col("pbo") + half, F.lit(1.0))).withColumn("efficiency", F.try_divide("mean_oos", "mean_is"))
    return d.withColumn("verdict", F.when(F.col("pbo") < 0.4, "ROBUST").when(F.col("pbo") < 0.55, "MODERATE").when(F.col("pbo") < 0.7, "FRAGILE").otherwise("OVERFIT"))


def rank_stability(sharpes: DataFrame, combo: str, keys: list[str]) -> DataFrame:
    """(keys, splits, rank_correlation): the mean over splits of Kendall's tau-b between combinations' Sharpes in and out of
    sample; splits where either side is all equal have none. sharpes: as `cpcv_sharpes` gives them."""
    other = sharpes.select(*keys, "split", F.col(combo).alias("_c"), F.col("ins").alias("_i"), F.col("out").alias("_o"))
    d = sharpes.join(other, [*keys, "split"]).where(F.col(combo) < F.col("_c"))
    a, b = F.signum(F.col("ins") - F.col("_i")), F.signum(F.col("out") - F.col("_o"))
    d = d.groupBy(*keys, "split").agg(F.sum(a * b).alias("s"), F.sum(a * a).alias("x"), F.sum(b * b).alias("y"))
    return d.groupBy(*keys).agg(F.count("*").alias("splits"), F.coalesce(F.avg(F.try_divide("s", F.sqrt(F.col("x") * F.col("y")))), F.lit(0.0)).alias("rank_correlation"))


def walk_forward(returns: DataFrame, combo: str, keys: list[str], folds: int = 5, purge: int = 0, rolling: bool = False, least: int = 20, least_out: int = 5) -> DataFrame:
    """(keys, fold, combo, is_sharpe, oos_sharpe): the combination that is best in sample, on the fold after it.

    A key's bars are cut into folds + 1 steps; fold k is step k, its sample all bars before it (rolling: one step) less the
    `purge` last ones, however many these are. Folds of under `least` bars in sample or `least_out` after it, and keys whose step
    is under ten bars, are left out; ties go to the smaller combination. Every combination of a key has the same bars; a
    fold's two runs of bars are differences of prefix sums.
    """
    rows, sizes = whole_units(numbered(returns.withColumn("r", m.finite("r")).where("r is not null"), [*keys, combo]).select(*keys, combo, "i", "r"), keys)
    d = sizes.withColumn("_step", F.floor(F.col("n") / (folds + 1))).where("_step >= 10").withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(folds))))
    k, step = F.col("_k"), F.col("_step")
    begin = step * (k - 1) if rolling else F.lit(0).cast("long")
    run = lambda test, a, b: F.struct((2 * k + F.lit(int(test))).alias("draw"), a.alias("start"), (b - a).alias("len"))
    d = d.select(*keys, "n", F.inline(F.array(run(True, step * k, F.least(step * (k + 1), F.col("n"))), run(False, begin, step * k - purge))))
    d = d.where(F.when(F.col("draw") % 2 == 1, F.col("len") >= max(least_out, 1)).otherwise(F.col("len") >= max(least, 1)))
    t = block_sums(rows, keys, ["r", "q", "bars"], d, [combo])
    t = t.join(sizes.drop("n"), keys).select(*keys, combo, F.floor(F.col("draw") / 2).cast("int").alias("fold"), (F.col("draw") % 2 == 1).alias("test"), sharpe_of_sums(m.PPY).alias("sharpe"))
    t = t.groupBy(*keys, "fold", combo).agg(F.max(F.when(~F.col("test"), F.col("sharpe"))).alias("ins"), F.max(F.when(F.col("test"), F.col("sharpe"))).alias("out")).where("ins is not null and out is not null")
    best = t.groupBy(*keys, "fold").agg(F.max(F.struct("ins", (-F.col(combo)).alias("neg"), "out")).alias("b"))
    return best.select(*keys, "fold", (-F.col("b.neg")).alias(combo), F.col("b.ins").alias("is_sharpe"), F.col("b.out").alias("oos_sharpe"))


def walk_forward_summary(folds: DataFrame, combo: str, keys: list[str]) -> DataFrame:
    """Per key: mean Sharpe in and out of sample, degradation, folds that stayed positive, and the share of the commonest winner."""
    won = folds.groupBy(*keys, combo).count().groupBy(*keys).agg(F.max("count").alias("top"))
    out = folds.groupBy(*keys).agg(F.count("*").alias("folds"), F.avg("is_sharpe").alias("is_mean"), F.avg("oos_sharpe").alias("oos_mean"), F.count_if(F.col("oos_sharpe") > 0).alias("positive"))
    return out.join(won, keys).withColumn("degradation", F.col("is_mean") - F.col("oos_mean")).withColumn("stability", F.col("top") / F.col("folds")).drop("top")


def best_by_regime(returns: DataFrame, combo: str, keys: list[str], regime: str = "regime", share: float = 0.7, least: int = 60, least_out: int = 30, ppy: int = m.PPY) -> DataFrame:
    """(keys, regime, n, coverage, skipped, combo, is_sharpe, oos_sharpe, n_train, n_out, consensus, votes): per regime the
    combination that is best on the first `share` of its bars, its Sharpe on the rest, and the combination that most regimes chose.

    Regimes of under `least` bars, or `least_out` after the cut (n * share, halves to the even number), are skipped: they
    have counts and coverage alone, and no vote. Of equal combinations the smaller one wins; of equal votes the winner of the
    smaller regime. Rows without a regime or a return take no part; every combination of a key has the same bars.
    """
    part = Window.partitionBy(*keys, regime, combo)
    d = returns.where(F.col("r").isNotNull() & F.col(regime).isNotNull()).withColumn("n", F.count("*").over(part)).withColumn("i", F.row_number().over(part.orderBy("dt")) - 1)
    d = d.withColumn("cut", F.bround(F.col("n") * share).cast("long"))
    early = F.col("i") < F.col("cut")
    one = lambda on: F.when(F.count_if(on) >= 2, m.sharpe(F.when(on, F.col("r")), ppy))
    d = d.groupBy(*keys, regime, combo).agg(F.first("n").alias("n"), F.first("cut").alias("cut"), one(early).alias("ins"), one(~early).alias("out"))
    d = d.groupBy(*keys, regime).agg(F.max("n").alias("n"), F.max("cut").alias("cut"), F.max(F.when(F.col("ins").isNotNull(), F.struct("ins", (-F.col(combo)).alias("neg"), "out"))).alias("b"))
    d = d.withColumn("skipped", (F.col("n") < least) | (F.col("n") - F.col("cut") < least_out) | F.col("b").isNull())
    used = lambda c: F.when(~F.col("skipped"), c)
    d = d.select(*keys, regime, "n", (F.col("n") / F.sum("n").over(Window.partitionBy(*keys))).alias("coverage"), "skipped", used(-F.col("b.neg")).alias(combo), used(F.col("b.ins")).alias("is_sharpe"), used(F.col("b.out")).alias("oos_sharpe"), used(F.col("cut")).alias("n_train"), used(F.col("n") - F.col("cut")).alias("n_out"))
    votes = d.where(~F.col("skipped")).groupBy(*keys, combo).agg(F.count("*").alias("votes"), F.min(regime).alias("first"))
    most = votes.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("votes"), "first"))).where("place = 1")
    return d.join(most.select(*keys, F.col(combo).alias("consensus"), "votes"), keys, "left")


def posterior_sharpe(returns: DataFrame, key: str = "run_id", mu: float = 0.0, kappa: float = 1.0, alpha: float = 2.0, beta: float = 1e-4, draws: int = 10_000, seed: int = 42) -> DataFrame:
    """Per run: the normal-inverse-gamma posterior of the yearly Sharpe: mean, 5 % and 95 % points, P(Sharpe > 1), and the decision.

    Spark aggregates each run to four numbers; only those are sampled from.
    """
    d = returns.groupBy(key).agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.var_samp("r").alias("var"))

    def f(frames):
        for p in frames:
            out = []
            for n, mean, var in zip(p.n, p["mean"], p["var"]):
                if n < 4:
                    out.append((np.nan,) * 4)
                    continue
                rng = np.random.default_rng(seed)
                b = beta + 0.5 * (n - 1) * var + kappa * n * (mean - mu) ** 2 / (2 * (kappa + n))
                s2 = b / rng.gamma(alpha + n / 2, size=draws)
                x = rng.normal((kappa * mu + n * mean) / (kappa + n), np.sqrt(s2 / (kappa + n))) / np.sqrt(s2) * np.sqrt(m.PPY)
                out.append((x.mean(), *np.percentile(x, [5, 95]), (x > 1).mean()))
            a = np.array(out).reshape(-1, 4)
            yield p.assign(posterior=a[:, 0], low=a[:, 1], high=a[:, 2], p_above=a[:, 3])[[key, "n", "posterior", "low", "high", "p_above"]]

    out = d.mapInPandas(f, f"{key} {returns.schema[key].dataType.simpleString()}, n long, posterior double, low double, high double, p_above double")
    p = F.col("p_above")
    return out.withColumn("decision", F.when(F.col("n") < 4, "INSUFFICIENT_DATA").when(p >= 0.8, "DEPLOY").when(p < 0.2, "REJECT").otherwise("WAIT"))
