"""Attacks on an edge: series of the same spectrum but without other structure, and noise on top of the returns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m

from .blocks import uniform
from .panel import along


def spectrum(series: DataFrame, key: str, value: str = "r", order: str = "dt") -> DataFrame:
    """(key, n, f, magnitude): the discrete Fourier transform of each key's values in order, f from 0 to n / 2; nulls are left out."""

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x = table.column(value).to_numpy()
        size = np.abs(np.fft.rfft(x))
        k = len(size)
        return pa.table([pa.array([table.column(key)[0].as_py()] * k, table.schema.field(key).type), np.full(k, len(x)), np.arange(k), size], [key, "n", "f", "magnitude"])

    d = series.select(key, order, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    return d.groupBy(key).applyInArrow(one, f"{key} {series.schema[key].dataType.simpleString()}, n long, f long, magnitude double")


def surrogates(series: DataFrame, key: str, draws: int, value: str = "r", order: str = "dt") -> DataFrame:
    """(key, draw, i, value): series with each key's magnitudes and phases from a digest of (draw, f).

    The zero frequency and, of an even number of values, the last one keep phase 0, so the mean's size, the variance and the
    circular autocorrelation stay. Phases are drawn where the frequencies lie; each draw is one group, of one key's length.
    """
    s = spectrum(series, key, value, order)
    s = s.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    fixed = (F.col("f") == 0) | (2 * F.col("f") == F.col("n"))
    phase = F.when(fixed, 0.0).otherwise(2 * math.pi * uniform(F.lit("phase"), "draw", "f"))
    s = s.select(key, "draw", "n", "f", (F.col("magnitude") * F.cos(phase)).alias("re"), (F.col("magnitude") * F.sin(phase)).alias("im"))

    def back(table: pa.Table) -> pa.Table:
        table = table.sort_by("f")
        n = table.column("n")[0].as_py()
        x = np.fft.irfft(table.column("re").to_numpy() + 1j * table.column("im").to_numpy(), n=n)
        same = lambda c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type)
        return pa.table([same(key), same("draw"), np.arange(n), x], [key, "draw", "i", value])

    return s.groupBy(key, "draw").applyInArrow(back, f"{key} {series.schema[key].dataType.simpleString()}, draw int, i long, {value} double")


def surrogate_test(prices: DataFrame, rule: Callable[[DataFrame], DataFrame], draws: int = 50, ppy: int = m.PPY) -> DataFrame:
    """(symbol, n, sharpe, surrogate_mean, surrogate_p95, p_value): a rule's Sharpe against its Sharpe on surrogate price paths.

    rule: prices (symbol, dt, price) -> returns (symbol, dt, r); it is run once on all paths, whose symbol is (symbol, draw).
    A path begins at the first price and follows a surrogate of the log returns. p: the share of surrogates, and of one more,
    that do as well. Symbols of under 32 prices, or with one that is not positive, are left out.
    """
    good = prices.where("price is not null").withColumn("n", F.count("*").over(Window.partitionBy("symbol"))).withColumn("low", F.min("price").over(Window.partitionBy("symbol")))
    good = good.where("n >= 32 and low > 0").select("symbol", "dt", "price", "n")
    steps = good.withColumn("r", F.ln("price") - F.lag(F.ln("price")).over(along("symbol"))).where("r is not null")
    days = good.select("symbol", "dt", "n", (F.row_number().over(along("symbol")) - 1).cast("long").alias("i"), F.first("price").over(along("symbol")).alias("p0"))
    paths = surrogates(steps, "symbol", draws).withColumn("i", F.col("i") + 1)
    first = days.where("i = 0").select("symbol", "i").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).select("symbol", "draw", "i", F.lit(0.0).alias("r"))
    paths = paths.unionByName(first).join(days, ["symbol", "i"])
    upto = along(["symbol", "draw"], "i").rowsBetween(Window.unboundedPreceding, 0)
    paths = paths.select(F.struct("symbol", "draw").alias("symbol"), "dt", (F.col("p0") * F.exp(F.sum("r").over(upto))).alias("price"))
    drawn = rule(paths).groupBy("symbol").agg(m.sharpe("r", ppy).alias("s")).select(F.col("symbol.symbol").alias("symbol"), "s")
    seen = rule(good.select("symbol", "dt", "price")).groupBy("symbol").agg(m.sharpe("r", ppy).alias("sharpe")).join(good.groupBy("symbol").agg(F.first("n").alias("n")), "symbol")
    d = drawn.join(seen, "symbol").groupBy("symbol", "n", "sharpe").agg(F.avg("s").alias("surrogate_mean"), F.percentile("s", F.lit(0.95)).alias("surrogate_p95"), ((1 + F.count_if(F.col("s") >= F.col("sharpe"))) / (1 + F.count("s"))).alias("p_value"))
    return d.withColumn("significant", F.col("p_value") < 0.05)


def noise_test(returns: DataFrame, levels: list[float], draws: int = 100, key: str = "run_id", ppy: int = m.PPY) -> DataFrame:
    """(key, level, n, base, sharpe, fragility): the mean Sharpe with normal noise of `level` deviations on every return.

    fragility: the share of a positive base that the highest level takes, over that level, at least 0; null without a positive
    base. The same noise serves every level, and a draw's Sharpe follows from five sums, so a resample is one row a key and
    draw. Keys of under 32 returns are left out.
    """
    of = Window.partitionBy(key)
    d = returns.where("r is not null").withColumn("i", F.row_number().over(along(key)) - 1).withColumn("n", F.count("*").over(of)).withColumn("sd", F.stddev_samp("r").over(of)).where("n >= 32")
    d = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    z = F.sqrt(-2 * F.ln(uniform(F.lit("radius"), "draw", "i"))) * F.cos(2 * math.pi * uniform(F.lit("angle"), "draw", "i"))
    d = d.withColumn("z", z * F.col("sd"))
    sums = d.groupBy(key, "draw").agg(F.count("*").alias("n"), *[F.avg(v).alias(x) for x, v in (("r", F.col("r")), ("z", F.col("z")))], F.var_samp("r").alias("rr"), F.var_samp("z").alias("zz"), F.covar_samp("r", "z").alias("rz"))
    sums = sums.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    k = F.col("level")
    year = F.sqrt(F.lit(float(ppy)))
    over = lambda top, var: F.when(var > 1e-24, top / F.sqrt(var) * year).otherwise(0.0)
    out = sums.groupBy(key, "level").agg(F.first("n").alias("n"), F.first(over(F.col("r"), F.col("rr"))).alias("base"), F.avg(over(F.col("r") + k * F.col("z"), F.col("rr") + 2 * k * F.col("rz") + k * k * F.col("zz"))).alias("sharpe"))
    last = F.max_by("sharpe", "level").over(of)
    worn = F.greatest((F.col("base") - last) / F.col("base") / max(levels), F.lit(0.0))
    return out.withColumn("fragility", F.when(F.col("base") > 1e-9, worn))
