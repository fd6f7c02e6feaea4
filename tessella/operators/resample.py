"""Tests that rest on block resamples: the set of models no worse than the best, and Sharpe ratios that are the best of many."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.functions import stats

from .blocks import block_sums, digest, family_sizes, numbered, stationary_blocks
from .panel import along
from .validation import sharpe_se


def confidence_set(losses: DataFrame, family: str, model: str, alpha: float = 0.1, draws: int = 200, block: float = 10.0) -> DataFrame:
    """(family, model, place, mean_loss, p_value, survives): the models that no test tells from the best.

    losses: family, model, dt, loss; every model of a family has the same dates. The model of greatest mean loss is taken out
    while the largest studentised difference of two means is rarer than alpha among the resamples; as models go in the order
    of their means (place 1 is the best; of equal ones the smaller name goes first), the sets of every size are tested at
    once, by a running maximum over pairs by the worse one's place. p_value: of the set that a model is the worst of, null for
    survivors. Under 30 dates or two models all survive. Pairs are compared within a draw, never dates.
    """
    rows = numbered(losses.where(F.col("loss").isNotNull()), [family, model]).select(family, model, "i", "loss")
    means = rows.groupBy(family, model).agg(F.avg("loss").alias("mean"), F.count("*").alias("n"))
    by = Window.partitionBy(family)
    means = means.withColumn("place", F.row_number().over(by.orderBy("mean", F.desc(model)))).withColumn("models", F.count("*").over(by))
    boot = block_sums(rows, [family], ["loss"], stationary_blocks(family_sizes(rows, [family]), draws, block), [model])
    boot = boot.select(family, model, "draw", (F.col("loss") / F.col("n")).alias("b")).join(means, [family, model]).select(family, "draw", "place", "n", "mean", (F.col("b") - F.col("mean")).alias("d"))
    x, y = boot.alias("x"), boot.alias("y")
    pairs = x.join(y, (F.col(f"x.{family}") == F.col(f"y.{family}")) & (F.col("x.draw") == F.col("y.draw")) & (F.col("x.place") < F.col("y.place")))
    pairs = pairs.select(F.col(f"x.{family}").alias(family), F.col("x.draw").alias("draw"), F.col("x.place").alias("a"), F.col("y.place").alias("place"), F.col("x.n").alias("n"), (F.col("x.d") - F.col("y.d")).alias("d"), (F.col("x.mean") - F.col("y.mean")).alias("gap"))
    pairs = pairs.withColumn("v", F.var_samp("d").over(Window.partitionBy(family, "a", "place")))
    scale = F.sqrt(F.col("v") / F.col("n") + 1e-30)
    t = lambda c: F.when(F.col("v") > 0, F.abs(F.col(c)) / scale).otherwise(0.0)
    top = pairs.groupBy(family, "draw", "place").agg(F.max(t("d")).alias("boot"), F.max(t("gap")).alias("seen"))
    of = along([family, "draw"], "place").rowsBetween(Window.unboundedPreceding, 0)
    top = top.select(family, "place", F.max("boot").over(of).alias("boot"), F.max("seen").over(of).alias("seen"))
    p = top.groupBy(family, "place").agg(F.avg((F.col("boot") >= F.col("seen")).cast("double")).alias("p"))
    out = means.join(p, [family, "place"], "left").withColumn("stop", F.max(F.when(F.col("p") >= alpha, F.col("place"))).over(by))
    lives = (F.col("n") < 30) | (F.col("models") < 2) | (F.col("place") <= F.coalesce("stop", F.lit(1)))
    return out.select(family, model, "place", F.col("mean").alias("mean_loss"), F.when(~lives, F.col("p")).alias("p_value"), lives.alias("survives"))


def romano_wolf(returns: DataFrame, family: str, trial: str, draws: int = 200, block: float = 10.0) -> DataFrame:
    """(family, trials, n, sharpe, expected_max, dsr, expected_max_normal, dsr_normal): the best trial's Sharpe a period against
    the mean of the largest Sharpe among all trials, each resampled around its own mean with all others; the last two take
    trials as independent and normal. returns: family, trial, dt, r; every trial of a family has the same dates. Families of
    under five dates or two trials are left out.
    """
    rows = numbered(returns.where("r is not null"), [family, trial]).select(family, trial, "i", "r")
    each = rows.groupBy(family, trial).agg(F.count("*").alias("n"), m.sharpe("r", 1).alias("sharpe"), m.skewness("r").alias("skew"), m.kurtosis("r").alias("kurt"))
    best = each.groupBy(family).agg(F.count("*").alias("trials"), F.max_by(F.struct("n", "sharpe", "skew", "kurt"), F.struct("sharpe", (-F.col(trial)).alias("neg"))).alias("b"))
    d = rows.withColumn("c", F.col("r") - F.avg("r").over(Window.partitionBy(family, trial)))
    d = d.select(family, trial, "i", "c", (F.col("c") * F.col("c")).alias("q"))
    boot = block_sums(d, [family], ["c", "q"], stationary_blocks(family_sizes(rows, [family]), draws, block), [trial])
    var = (F.col("q") - F.col("c") * F.col("c") / F.col("n")) / (F.col("n") - 1)
    boot = boot.withColumn("s", F.when(var > 1e-24, F.col("c") / F.col("n") / F.sqrt(var)).otherwise(0.0)).groupBy(family, "draw").agg(F.max("s").alias("top"))
    out = boot.groupBy(family).agg(F.avg("top").alias("expected_max")).join(best, family).select(family, "trials", "b.n", "b.sharpe", "b.skew", "b.kurt", "expected_max").where("n >= 5 and trials >= 2")
    k = F.col("trials").cast("double")
    normal = ((1 - stats.EULER) * stats.norm_ppf(1 - 1 / k) + stats.EULER * stats.norm_ppf(1 - 1 / (k * math.e))) / F.sqrt(F.col("n") - 1)
    out = out.withColumn("expected_max_normal", normal).withColumn("se", sharpe_se(F.col("sharpe"), F.col("n"), F.col("skew"), F.col("kurt")))
    deflated = lambda top: F.when(F.col("se") > 0, stats.norm_cdf((F.col("sharpe") - F.col(top)) / F.col("se"))).otherwise(0.5)
    return out.select(family, "trials", "n", "sharpe", "expected_max", deflated("expected_max").alias("dsr"), "expected_max_normal", deflated("expected_max_normal").alias("dsr_normal"))


def best_of_many(returns: DataFrame, alternatives: int, key: str = "run_id", draws: int = 100, ppy: int = m.PPY) -> DataFrame:
    """(key, sharpe, expected_max, inflation, p_value, verdict): a Sharpe against the largest of `alternatives` resamples of its
    own returns, bar by bar with replacement. Keys of under 30 bars, or one alternative: p 1, insufficient_data."""
    rows = numbered(returns.where("r is not null"), [key]).select(key, "i", "r")
    seen = rows.groupBy(key).agg(F.count("*").alias("n"), m.sharpe("r", ppy).alias("sharpe"))
    picks = seen.where("n >= 30").select(key, "n").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(alternatives - 1))))
    picks = picks.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(key, "draw", "a", (digest("draw", "a", "j") % F.col("n")).alias("i"))
    s = picks.join(rows, [key, "i"]).groupBy(key, "draw", "a").agg(m.sharpe("r", ppy).alias("s")).groupBy(key, "draw").agg(F.max("s").alias("top"))
    d = seen.join(s, key, "left").groupBy(key, "n", "sharpe").agg(F.avg("top").alias("expected_max"), ((1 + F.count_if(F.col("top") >= F.col("sharpe"))) / (1 + F.count("top"))).alias("p"))
    few = (F.col("n") < 30) | F.lit(alternatives < 2)
    p = F.when(few, 1.0).otherwise(F.col("p"))
    verdict = F.when(few, "insufficient_data").when(p < 0.05, "EDGE_BEYOND_OPTIM_BIAS").when(p < 0.2, "BORDERLINE").otherwise("OPTIM_BIAS_LIKELY")
    inflation = F.when(F.abs("expected_max") > 1e-9, F.col("sharpe") / F.col("expected_max")).otherwise(float("inf"))
    return d.select(key, "sharpe", "expected_max", inflation.alias("inflation"), p.alias("p_value"), verdict.alias("verdict"))


def _family_means(returns: DataFrame, family: str, trial: str, draws: int, block: float) -> tuple[DataFrame, DataFrame]:
    """(family, trial, n, mean, sd) of every trial, and (family, trial, draw, n, mean, sd, boot), boot the mean of a stationary resample."""
    rows = numbered(returns.where("r is not null"), [family, trial]).select(family, trial, "i", "r")
    each = rows.groupBy(family, trial).agg(F.count("*").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"))
    boot = block_sums(rows, [family], ["r"], stationary_blocks(family_sizes(rows, [family]), draws, block), [trial])
    return each, boot.select(family, trial, "draw", (F.col("r") / F.col("n")).alias("boot")).join(each, [family, trial])


def reality_check(returns: DataFrame, family: str, trial: str, draws: int = 200, block: float = 10.0) -> DataFrame:
    """(family, trials, statistic, p_value): White's reality check: the best mean of all trials, times the root of the dates,
    against the largest deviation of their resampled means. returns: family, trial, dt, r (excess over the benchmark); every
    trial of a family has the same dates. p counts the data as one more resample."""
    each, boot = _family_means(returns, family, trial, draws, block)
    seen = each.groupBy(family).agg(F.count("*").alias("trials"), (F.max("mean") * F.sqrt(F.max("n").cast("double"))).alias("statistic"))
    top = boot.groupBy(family, "draw").agg(F.max((F.col("boot") - F.col("mean")) * F.sqrt(F.col("n"))).alias("v"))
    return seen.join(top, family).groupBy(family, "trials", "statistic").agg(((1 + F.count_if(F.col("v") >= F.col("statistic"))) / (1 + F.count("*"))).alias("p_value"))


def superior_ability(returns: DataFrame, family: str, trial: str, draws: int = 200, block: float = 10.0, alpha: float = 0.05) -> DataFrame:
    """(family, trials, statistic, p_lower, p_consistent, p_upper, rejected): the studentised test of superior ability with its three
    recentrings (every mean, means that are not clearly bad, none), and how many trials a step-down test rejects.

    A step rejects the trials over the (1 - alpha) quantile of the largest studentised deviation among those still left. As the best
    go first, what is left is a tail of the order by t, and the quantiles of all tails come from one running maximum. Trials
    without any movement have t 0 and no deviation. returns as for `reality_check`.
    """
    each, boot = _family_means(returns, family, trial, draws, block)
    scale = F.when(F.col("sd") > 0, F.col("sd") / F.sqrt(F.col("n")))
    t = F.coalesce(F.col("mean") / scale, F.lit(0.0))
    bad = -F.sqrt(2 * F.ln(F.ln(F.greatest(F.col("n"), F.lit(3)))))
    seen = each.withColumn("t", t).groupBy(family).agg(F.count("*").alias("trials"), F.max("t").alias("statistic"))
    places = each.select(family, trial, F.row_number().over(Window.partitionBy(family).orderBy(F.desc(t), trial)).alias("place"), t.alias("t"))
    d = boot.join(places, [family, trial])
    over = lambda centre: F.coalesce((F.col("boot") - centre) / scale, F.lit(0.0))
    near = F.when(F.col("t") >= bad, F.col("mean")).otherwise(0.0)
    tops = d.groupBy(family, "draw").agg(*[F.max(over(c)).alias(x) for x, c in (("lower", F.col("mean")), ("consistent", near), ("upper", F.lit(0.0)))])
    p = tops.join(seen, family).groupBy(family, "trials", "statistic").agg(*[F.avg((F.col(x) >= F.col("statistic")).cast("double")).alias(f"p_{x}") for x in ("lower", "consistent", "upper")])
    tail = Window.partitionBy(family, "draw").orderBy(F.desc("place")).rowsBetween(Window.unboundedPreceding, 0)
    tails = d.withColumn("z", F.max(over(F.col("mean"))).over(tail)).groupBy(family, "place", "t").agg(F.percentile("z", F.lit(1 - alpha)).alias("bound"))
    steps = tails.groupBy(family).agg(F.array_sort(F.collect_list(F.struct("place", "t", "bound"))).alias("x"))
    # gone: how many are rejected so far; the next step's bound is that of the tail behind them
    more = lambda gone: F.size(F.filter("x", lambda e: e["t"] > F.try_element_at("x", gone + 1)["bound"]))
    gone = F.aggregate(F.sequence(F.lit(1), F.size("x")), F.lit(0), lambda acc, _: F.when(acc < F.size("x"), F.greatest(acc, more(acc))).otherwise(acc))
    return p.join(steps.select(family, gone.alias("rejected")), family)
