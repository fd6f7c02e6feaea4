"""Trades that bars' extremes decide: which of stop and target is touched first, and how far a trade stood against its side."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_touch(entries: DataFrame, bars: DataFrame, keys: Sequence[str] = ("symbol", "session"), order: str = "bar") -> DataFrame:
    """entries with exit_bar, outcome (stop, target, end, none), pnl and worst (points, from the entry's side).

    entries: keys, order, entry, side (1 or -1), stop, target. bars: keys, order, high, low, close. A trade looks at the later
    bars of its session; a bar that spans both touches the stop. The worst mark takes each bar's adverse extreme up to the
    exit, and is at most 0 and, at a stop or the session's end, at most the result. An entry at the last bar: none, 0 and 0.

    A session's bars travel as one array (a session is a day), so an entry meets them in one row and pairs are never rows.
    """
    day = bars.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "high", "low", "close"))).alias("_bars"))
    side, entry = F.col("side"), F.col("entry")
    long = side == 1
    stopped = lambda b: F.when(long, b["low"] <= F.col("stop")).otherwise(b["high"] >= F.col("stop"))
    reached = lambda b: F.when(long, b["high"] >= F.col("target")).otherwise(b["low"] <= F.col("target"))
    d = entries.join(day, list(keys), "left")
    d = d.withColumn("_later", F.filter("_bars", lambda b: b[order] > F.col(order)))
    d = d.withColumn("_hit", F.get(F.filter("_later", lambda b: stopped(b) | reached(b)), F.lit(0)))
    d = d.withColumn("_last", F.coalesce("_hit", F.try_element_at("_later", F.lit(-1))))
    outcome = F.when(F.col("_last").isNull(), "none").when(F.col("_hit").isNull(), "end").when(stopped(F.col("_hit")), "stop").otherwise("target")
    d = d.withColumn("outcome", outcome).withColumn("exit_bar", F.col(f"_last.{order}"))
    leaves = F.when(F.col("outcome") == "stop", F.col("stop")).when(F.col("outcome") == "target", F.col("target")).when(F.col("outcome") == "end", F.col("_last.close"))
    d = d.withColumn("pnl", F.coalesce((leaves - entry) * side, F.lit(0.0)))
    marks = F.transform(F.filter("_later", lambda b: b[order] <= F.col("exit_bar")), lambda b: (F.when(long, b["low"]).otherwise(b["high"]) - entry) * side)
    worst = F.least(F.lit(0.0), F.coalesce(F.array_min(marks), F.lit(0.0)))
    d = d.withColumn("worst", F.when(F.col("outcome").isin("stop", "end"), F.least(worst, F.col("pnl"))).otherwise(worst))
    return d.drop("_bars", "_later", "_hit", "_last")
