"""Several breaks in one series: in variance by iterated cumulated squares, in mean by residual squares and BIC.

Each bar carries the bounds of the segment that it lies in; a round finds the best place in every segment of every key at
once, from prefix sums, and moves the bounds. All windows are by key, so a key's bars are shuffled once for all rounds.
Bars with a null return take no part.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import along

#: Fixed value: the 95 % point of the supremum of a Brownian bridge, as used for cumulated squares.
SQUARES = 1.358


def _bars(returns: DataFrame, key: str) -> DataFrame:
    d = returns.where("r is not null").select(key, "dt", "r")
    return d.withColumn("n", F.count("*").over(Window.partitionBy(key))).withColumn("i", (F.row_number().over(along(key)) - 1).cast("long"))


def variance_breaks(returns: DataFrame, key: str = "run_id", rounds: int = 5, critical: float = SQUARES, edge: int = 5) -> DataFrame:
    """(key, segment, start_dt, end_dt, n, variance): the mean square between breaks.

    A segment of at least ten bars is cut where the share of its squares leaves the share of its bars furthest (the first such
    bar opens the later part), if the distance times the root of half its bars is over `critical` and the cut lies more than
    `edge` bars from both ends; `rounds` rounds at most. Keys of under 50 bars, or without any movement, stay whole.
    """
    square = F.col("r") * F.col("r")
    d = _bars(returns, key).withColumn("c", F.sum(square).over(along(key).rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.lit(0).cast("long"))
    for _ in range(rounds):
        seg = Window.partitionBy(key, "start")
        d = d.withColumn("m", F.count("*").over(seg)).withColumn("before", F.min(F.col("c") - square).over(seg)).withColumn("sum", F.max("c").over(seg) - F.col("before"))
        share = F.try_divide(F.col("c") - F.col("before"), F.col("sum"))
        top = F.max(F.struct(F.abs(share - (F.col("i") - F.col("start") + 1) / F.col("m")).alias("far"), (-F.col("i")).alias("neg"))).over(seg)
        d = d.withColumn("far", top["far"]).withColumn("at", -top["neg"])
        inside = (F.col("at") > F.col("start") + edge) & (F.col("at") < F.col("start") + F.col("m") - edge)
        cut = (F.col("n") >= 50) & (F.col("m") >= 10) & inside & (F.sqrt(F.col("m") / 2) * F.col("far") > critical)
        d = d.withColumn("start", F.when(cut & (F.col("i") >= F.col("at")), F.col("at")).otherwise(F.col("start")))
    out = d.groupBy(key, "start").agg(F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count("*").alias("n"), F.avg(square).alias("variance"))
    return out.withColumn("segment", F.row_number().over(along(key, "start")) - 1).drop("start")


def mean_breaks(returns: DataFrame, key: str = "run_id", least: int = 252, rounds: int = 5) -> DataFrame:
    """(key, segment, start_dt, end_dt, n, mean, sd, breaks, verdict): the mean between breaks.

    Break after break is put where it lowers the residual squares most, at least `least` bars from the ends and all others;
    of 0 to `rounds` breaks the number of lowest BIC stays (the smaller, where two are equal). `least` is a year of bars: 252
    of days, 52 of weeks, 12 of months. Keys of under twice as many bars are one segment, INSUFFICIENT_DATA.
    """
    of, upto = Window.partitionBy(key), along(key).rowsBetween(Window.unboundedPreceding, -1)
    square = F.col("r") * F.col("r")
    d = _bars(returns, key).withColumn("s", F.coalesce(F.sum("r").over(upto), F.lit(0.0))).withColumn("q", F.coalesce(F.sum(square).over(upto), F.lit(0.0)))
    i, n = F.col("i"), F.col("n")

    def residual(a: str, b: str) -> Column:
        at = lambda x, k: F.col(x if k == "i" else f"{x}_{k}")
        size = at("i" if b == "i" else "p", b) - at("i" if a == "i" else "p", a)
        return at("q", b) - at("q", a) - F.try_divide((at("s", b) - at("s", a)) * (at("s", b) - at("s", a)), size)

    d = d.select("*", F.lit(0).cast("long").alias("p_lo"), F.lit(0.0).alias("s_lo"), F.lit(0.0).alias("q_lo"), n.alias("p_hi"), F.sum("r").over(of).alias("s_hi"), F.sum(square).over(of).alias("q_hi"), F.lit(None).cast("int").alias("placed"))
    d = d.withColumn("left", residual("lo", "hi"))
    bic = lambda k: n * F.ln(F.greatest(F.col("left") / n, F.lit(1e-12))) + k * F.ln(n)
    d = d.withColumn("bic_0", bic(2))
    for k in range(1, rounds + 1):
        open_ = (i - F.col("p_lo") >= least) & (F.col("p_hi") - i >= least) & (i < n - least) & (n >= 2 * least)
        gain = residual("lo", "hi") - residual("lo", "i") - residual("i", "hi")
        d = d.withColumn("best", F.max(F.when(open_, F.struct(gain.alias("gain"), (-i).alias("neg"), "s", "q"))).over(of))
        at, found = -F.col("best.neg"), F.col("best").isNotNull()
        hit = found & (F.col("p_lo") < at) & (at < F.col("p_hi"))
        moved = {"left": F.when(found, F.col("left") - F.col("best.gain")), "placed": F.when(found & (i == at), F.lit(k)).otherwise(F.col("placed"))}
        for end, side in (("lo", i >= at), ("hi", i < at)):
            for x, v in (("p", at), ("s", F.col("best.s")), ("q", F.col("best.q"))):
                moved[f"{x}_{end}"] = F.when(hit & side, v).otherwise(F.col(f"{x}_{end}"))
        d = d.withColumns(moved)
        d = d.withColumn(f"bic_{k}", bic(2 * k + 1))
    curve = [F.col(f"bic_{k}") for k in range(rounds + 1)]
    lowest = reduce(lambda a, b: F.least(a, b), curve) if rounds else curve[0]
    chosen = reduce(lambda rest, k: F.when(curve[k] == lowest, k).otherwise(rest), reversed(range(rounds + 1)), F.lit(0))
    d = d.withColumn("breaks", F.when(n < 2 * least, 0).otherwise(chosen))
    d = d.withColumn("segment", F.count_if(F.col("placed") <= F.col("breaks")).over(along(key).rowsBetween(Window.unboundedPreceding, 0)))
    out = d.groupBy(key, "segment").agg(F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count("*").alias("n"), F.avg("r").alias("mean"), F.coalesce(F.stddev_samp("r"), F.lit(0.0)).alias("sd"), F.first("breaks").alias("breaks"), F.first("n").alias("all"))
    verdict = F.when(F.col("all") < 2 * least, "INSUFFICIENT_DATA").when(F.col("breaks") == 0, "STABLE").when(F.col("breaks") <= 2, "SHIFTING").otherwise("FRAGMENTED")
    return out.withColumn("verdict", verdict).drop("all")
