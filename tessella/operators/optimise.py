"""The optimiser: a coarse and a fine search over a grid, and one report a key on what the winner is worth.

A rule turns prices and a table of combinations into returns of every combination; all that follows works on long returns
(key, combo, dt, r), so keys and combinations are rows, never loops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import metrics as m

from . import grid, resample, search, validation


def two_pass(prices: DataFrame, rule: Callable[[DataFrame, DataFrame], DataFrame], levels: dict[str, list], key: str, most: int = 64, span: int = 1) -> DataFrame:
    """(key, combo, parameters, dt, r): returns of a thinned grid of at most `most` combinations, and of all combinations within
    `span` levels of each key's best one; a combination of both passes comes once. combo numbers the whole grid.

    rule(prices, combinations) -> (key, parameters, dt, r). The second pass runs the union of all keys' neighbourhoods and keeps
    each key's own.
    """
    spark, params = prices.sparkSession, list(levels)
    every = grid.lattice(spark, levels)
    numbers = every.select("combo", *params)
    coarse = grid.lattice(spark, levels, most).select(*params)
    first = rule(prices, coarse).join(numbers, params)
    best = search.best_combo(first, "combo", [key]).join(numbers, "combo")
    near = grid.neighbours(every, best, [key], span).select(key, "combo")
    more = near.join(coarse.join(numbers, params).select("combo"), "combo", "left_anti")
    second = rule(prices, more.select("combo").distinct().join(numbers, "combo").select(*params)).join(numbers, params).join(more, [key, "combo"], "left_semi")
    columns = [key, "combo", *params, "dt", "r"]
    return first.select(columns).unionByName(second.select(columns))


def report(returns: DataFrame, key: str, default: int, prior: int = 0, purge: int = 0, embargo: int = 0, draws: int = 200, block: float = 10.0, folds: int = 5, ppy: int = m.PPY) -> DataFrame:
    """(key, tried, combo, sharpe, default_sharpe, improvement, pbo, score, grade, verdict, reality_p, able_p, rejected, wf_is,
    wf_oos, wf_positive, wf_stability) of every key's best combination.

    The verdict's deflation counts the combinations tried and `prior` ones of earlier searches. The snooping tests ask whether any
    combination beats the `default` one (cash, where a key has not tried it); they need five combinations. Walk-forward columns are
    null where no fold is long enough. Every combination of a key has the same dates; ties go to the smaller combo.
    """
    each = returns.groupBy(key, "combo").agg(m.sharpe("r", ppy).alias("sharpe"))
    best = search.best_combo(returns, "combo", [key]).select(key, "combo").join(each, [key, "combo"])
    tried = each.groupBy(key).agg(F.count("*").alias("tried"), F.max(F.when(F.col("combo") == default, F.col("sharpe"))).alias("default_sharpe"))
    judged = validation.validate_search(returns, "combo", key, purge, embargo, ppy, prior).select(F.col("run_id").alias(key), "pbo", "score", "grade", "verdict")
    base = returns.where(F.col("combo") == default).select(key, "dt", F.col("r").alias("base"))
    excess = returns.join(base, [key, "dt"], "left").select(key, "combo", "dt", (F.col("r") - F.coalesce("base", F.lit(0.0))).alias("r"))
    excess = excess.join(tried.where("tried >= 5").select(key), key, "left_semi")
    reality = resample.reality_check(excess, key, "combo", draws, block).select(key, F.col("p_value").alias("reality_p"))
    able = resample.superior_ability(excess, key, "combo", draws, block).select(key, F.col("p_consistent").alias("able_p"), "rejected")
    walked = search.walk_forward_summary(search.walk_forward(returns, "combo", [key], folds, purge), "combo", [key])
    walked = walked.select(key, F.col("is_mean").alias("wf_is"), F.col("oos_mean").alias("wf_oos"), F.col("positive").alias("wf_positive"), F.col("stability").alias("wf_stability"))
    out = best.join(tried, key).withColumn("improvement", F.col("sharpe") - F.col("default_sharpe")).join(judged, key)
    return out.join(reality, key, "left").join(able, key, "left").join(walked, key, "left")


def trials_before(log: DataFrame, name: str) -> int:
    """How many combinations a rule's earlier searches have tried, by a log (rule, at, trials) with a row a search."""
    return log.where(F.col("rule") == name).agg(F.sum("trials")).head()[0] or 0
