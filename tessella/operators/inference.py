"""Statistical tests over long tables of returns, each one aggregation per key after at most one window or join.

Rows with a null value take no part; keys with too few rows give null statistics.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.functions import stats

from .blocks import block_sums, circular_blocks, family_sizes, lagged_products, numbered
from .panel import along


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def biased_moments(r: str = "r") -> list[Column]:
    return [F.count(r).alias("n"), F.skewness(r).alias("skew"), F.kurtosis(r).alias("kurt")]


def jarque_bera(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, n, statistic, p_value, is_normal) from the biased moments."""
    d = returns.groupBy(key).agg(*biased_moments())
    d = d.withColumn("statistic", F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow("kurt", F.lit(2)) / 4))
    d = d.withColumn("p_value", stats.chi2_sf_of("statistic", 2))
    return d.select(key, "n", "statistic", "p_value", (F.col("p_value") > 0.05).alias("is_normal"))


def runs_test(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, runs, z, p_value): runs above and not above the median."""
    mid = returns.groupBy(key).agg(F.median("r").alias("mid"))
    d = returns.where("r is not null").join(mid, key).withColumn("up", F.col("r") > F.col("mid"))
    d = d.withColumn("turn", (F.col("up") != F.lag("up").over(along(key))).cast("int"))
    d = d.groupBy(key).agg((1 + F.coalesce(F.sum("turn"), F.lit(0))).alias("runs"), F.count_if("up").cast("double").alias("a"), F.count_if(~F.col("up")).cast("double").alias("b"))
    both, n = 2 * F.col("a") * F.col("b"), F.col("a") + F.col("b")
    z = (F.col("runs") - 1 - both / n) / F.sqrt(both * (both - n) / (n * n * (n - 1)))
    return d.withColumn("z", z).select(key, "runs", "z", stats.two_sided("z").alias("p_value"))


def variance_ratio(returns: DataFrame, qs: list[int], key: str = "run_id") -> DataFrame:
    """(key, q, vr, z, p_value, reading): overlapping q-sums against single returns, from one prefix sum."""
    w = along(key)
    d = returns.where("r is not null").withColumn("s", F.sum("r").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(w))
    back = F.array(*[F.struct(F.lit(q).alias("q"), F.when(F.col("i") >= q, F.coalesce(F.lag("s", q).over(w), F.lit(0.0))).alias("old")) for q in qs])
    d = d.withColumn("back", back).select(key, "r", "s", F.inline("back"))
    d = d.groupBy(key, "q").agg(F.count("r").cast("double").alias("n"), F.avg("r").alias("mu"), F.var_samp("r").alias("v"), F.sum(F.col("s") - F.col("old")).alias("t1"), F.sum((F.col("s") - F.col("old")) ** 2).alias("t2"), F.count("old").alias("k"))
    q, n = F.col("q"), F.col("n")
    spread = F.col("t2") - 2 * q * F.col("mu") * F.col("t1") + F.col("k") * (q * F.col("mu")) ** 2
    d = d.withColumn("vr", spread / (q * (n - q + 1) * (1 - q / n)) / F.col("v"))
    d = d.withColumn("z", (F.col("vr") - 1) / F.sqrt(2 * (2 * q - 1) * (q - 1) / (3 * q * n))).withColumn("p_value", stats.two_sided("z"))
    return d.select(key, "q", "vr", "z", "p_value", F.when(F.col("vr") > 1.2, "trending").when(F.col("vr") < 0.8, "mean_reverting").otherwise("random_walk").alias("reading"))


def ljung_box(returns: DataFrame, lags: int = 10, key: str = "run_id") -> DataFrame:
    """(key, n, statistic, p_value); autocovariances from lagged columns of one window."""
    w = along(key)
    d = returns.where("r is not null").withColumn("d", F.col("r") - F.avg("r").over(Window.partitionBy(key)))
    d = d.select(key, "d", *[F.lag("d", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)])
    d = d.groupBy(key).agg(F.count("d").cast("double").alias("n"), F.sum(F.col("d") ** 2).alias("c0"), *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    n = F.col("n")
    q = sum((F.pow(F.col(f"c{k}") / F.col("c0"), F.lit(2)) / (n - k) for k in range(1, lags + 1)), F.lit(0.0))
    return d.withColumn("statistic", n * (n + 2) * q).select(key, "n", "statistic", stats.chi2_sf_of("statistic", lags).alias("p_value"))


def var_backtest(returns: DataFrame, level: float = 0.05, key: str = "run_id") -> DataFrame:
    """Kupiec's proportion and Christoffersen's independence tests of the breaches of the sample quantile."""
    edge = returns.groupBy(key).agg(F.percentile("r", F.lit(level)).alias("edge"))
    d = returns.where("r is not null").join(edge, key).withColumn("b", (F.col("r") < F.col("edge")).cast("int"))
    d = d.withColumn("p", F.lag("b").over(along(key)))
    on = lambda p, b: F.count_if((F.col("p") == p) & (F.col("b") == b)).cast("double").alias(f"n{p}{b}")
    d = d.groupBy(key).agg(F.count("*").alias("n"), F.sum("b").alias("breaches"), on(0, 0), on(0, 1), on(1, 0), on(1, 1))
    log = lambda x: F.when(x > 0, F.log(x)).otherwise(0.0)
    x, n = F.col("breaches").cast("double"), F.col("n").cast("double")
    rate = x / n
    fit = F.when((rate > 0) & (rate < 1), x * log(rate) + (n - x) * log(1 - rate)).otherwise(0.0)
    d = d.withColumn("lr_pof", F.greatest(-2 * (x * F.log(F.lit(level)) + (n - x) * F.log(F.lit(1 - level)) - fit), F.lit(0.0)))
    c = {k: F.col(k) for k in ("n00", "n01", "n10", "n11")}
    p01, p11 = F.coalesce(F.try_divide(c["n01"], c["n00"] + c["n01"]), F.lit(0.0)), F.coalesce(F.try_divide(c["n11"], c["n10"] + c["n11"]), F.lit(0.0))
    pi = (c["n01"] + c["n11"]) / (c["n00"] + c["n01"] + c["n10"] + c["n11"])
    one = (c["n00"] + c["n10"]) * log(1 - pi) + (c["n01"] + c["n11"]) * log(pi)
    two = c["n00"] * log(1 - p01) + c["n01"] * log(p01) + c["n10"] * log(1 - p11) + c["n11"] * log(p11)
    d = d.withColumn("lr_ind", F.greatest(-2 * (one - two), F.lit(0.0))).withColumn("lr_cc", F.col("lr_pof") + F.col("lr_ind"))
    d = d.withColumn("p_pof", stats.chi2_sf_of("lr_pof", 1)).withColumn("p_ind", stats.chi2_sf_of("lr_ind", 1)).withColumn("p_cc", stats.chi2_sf_of("lr_cc", 2))
    bad_rate, bad_ind = F.col("p_pof") < 0.05, F.col("p_ind") < 0.05
    return d.withColumn("verdict", F.when(F.col("p_cc") >= 0.05, "PASS").when(bad_rate & bad_ind, "FAIL_RATE_AND_CLUSTERING").when(bad_rate, "FAIL_RATE").otherwise("FAIL_CLUSTERING"))


def tail_index(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """Hill, Pickands and moment estimates from the floor(sqrt(n)) largest losses; null under 20 losses."""
    losses = returns.where("r < 0").select(key, (-F.col("r")).alias("x"))
    d = losses.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("x")))).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    d = d.where("n >= 20").withColumn("k", F.floor(F.sqrt("n")))
    d = d.withColumn("kp", F.when(4 * F.col("k") > F.col("n"), F.floor(F.col("n") / 4)).otherwise(F.col("k")))
    at = lambda i: F.max(F.when(F.col("rank") == i, F.col("x")))
    top = F.when(F.col("rank") <= F.col("k"), F.log("x"))
    d = d.groupBy(key, "k").agg(F.avg(top).alias("a1"), F.avg(top * top).alias("a2"), at(F.col("k")).alias("xk"), at(F.col("kp")).alias("x1"), at(2 * F.col("kp")).alias("x2"), at(4 * F.col("kp")).alias("x4"))
    last = F.log("xk")
    d = d.withColumn("m1", F.col("a1") - last).withColumn("m2", F.col("a2") - 2 * last * F.col("a1") + last * last)
    d = d.withColumn("hill", F.col("m1")).withColumn("pickands", F.log((F.col("x1") - F.col("x2")) / (F.col("x2") - F.col("x4"))) / F.log(F.lit(2.0)))
    d = d.withColumn("moment", F.when(F.col("m2") > F.col("m1") ** 2, F.col("m1") + 1 - 0.5 / (1 - F.col("m1") ** 2 / F.col("m2"))).otherwise(F.col("m1")))
    return d.select(key, "k", "hill", "pickands", "moment", (1 / F.col("hill") < 4).alias("fat_tailed"))


def half_life(series: DataFrame, value: str, key: str) -> DataFrame:
    """Mean reversion of a series: the slope of its changes on its level, its t statistic and the half-life."""
    d = series.where(_col(value).isNotNull()).withColumn("l", F.lag(value).over(along(key))).where("l is not null")
    d = d.withColumn("y", _col(value) - F.col("l"))
    d = d.groupBy(key).agg(F.count("*").alias("n"), F.regr_slope("y", "l").alias("b"), F.regr_sxx("y", "l").alias("sxx"), F.regr_syy("y", "l").alias("syy"), F.regr_sxy("y", "l").alias("sxy"))
    # residuals have mean zero, so their variance with two degrees less follows from the sums
    s2 = (F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / (F.col("n") - 2)
    d = d.withColumn("kappa", -F.col("b")).withColumn("t_stat", F.col("b") / F.sqrt(s2 / F.col("sxx")))
    return d.select(key, "n", "kappa", "t_stat", F.when(F.col("kappa") > 0, F.log(F.lit(2.0)) / F.col("kappa")).alias("half_life"))


def breadth(ics: DataFrame, turnover: float, cost_bps: float, ic: str = "ic") -> DataFrame:
    """One row: information coefficient before and after costs, breadth from its autocorrelation, and the ratios that follow."""
    d = ics.where(_col(ic).isNotNull()).withColumn("before", F.lag(ic).over(Window.partitionBy("family").orderBy("dt")))
    d = d.groupBy("family").agg(F.count(ic).alias("n"), F.avg(ic).alias("gross"), F.stddev_samp(ic).alias("vol"), F.corr(ic, "before").alias("rho"))
    rho = F.least(F.greatest(F.coalesce("rho", F.lit(0.0)), F.lit(-0.99)), F.lit(0.99))
    d = d.withColumn("drag", F.lit(turnover * cost_bps / 1e4) / F.col("vol")).withColumn("net", F.col("gross") - F.col("drag")).withColumn("breadth", F.col("n") * (1 - rho) / (1 + rho))
    return d.withColumn("gross_ir", F.col("gross") / F.col("vol")).withColumn("net_ir", F.col("net") / F.col("vol")).withColumn("icir_flam", F.col("gross") * F.sqrt("breadth"))


def forecast_errors(pairs: DataFrame, predicted: str, actual: str, key: str, zero: float = 1e-8) -> DataFrame:
    """(key, n, mae, rmse, mape); actuals under `zero` take no part in mape."""
    e = F.col(actual) - F.col(predicted)
    d = pairs.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return d.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.when(F.abs(actual) >= zero, F.abs(e / F.col(actual)))).alias("mape"))


def sharpe_difference(wide: DataFrame, a: str, b: str, ppy: int = m.PPY) -> DataFrame:
    """Memmel's test that two aligned series have one Sharpe ratio, and the paired mean difference."""
    d = wide.agg(F.count("*").alias("n"), *[f(x).alias(f"{k}_{x}") for x in (a, b) for k, f in (("mu", F.avg), ("sd", F.stddev_samp))], F.corr(a, b).alias("rho"), F.avg(F.col(a) - F.col(b)).alias("diff_mean"), F.stddev_samp(F.col(a) - F.col(b)).alias("diff_sd"))
    x, y, rho = F.col(f"mu_{a}") / F.col(f"sd_{a}"), F.col(f"mu_{b}") / F.col(f"sd_{b}"), F.col("rho")
    d = d.withColumn("z", (x - y) / F.sqrt((2 - 2 * rho + 0.5 * (x * x + y * y - 2 * x * y * rho * rho)) / F.col("n"))).withColumn("p_value", stats.two_sided("z"))
    scale = F.sqrt(F.lit(float(ppy)))
    return d.select("n", (x * scale).alias("sharpe_a"), (y * scale).alias("sharpe_b"), ((x - y) * scale).alias("sharpe_diff"), "z", "p_value", "rho", "diff_mean", (F.col("diff_mean") / F.col("diff_sd") * F.sqrt("n")).alias("paired_t"))


def stress_capture(wide: DataFrame, a: str, b: str, tail: float = 0.1) -> DataFrame:
    """Mean of a over mean of b where b is in its lowest and in its highest tail."""
    q = wide.agg(F.percentile(b, F.lit(tail)).alias("lo"), F.percentile(b, F.lit(1 - tail)).alias("hi"))  # one row
    d = wide.crossJoin(F.broadcast(q))
    down, up = F.col(b) <= F.col("lo"), F.col(b) >= F.col("hi")
    share = lambda on: F.avg(F.when(on, F.col(a))) / F.avg(F.when(on, F.col(b)))
    d = d.agg(F.count_if(up).alias("n_up"), F.count_if(down).alias("n_down"), share(up).alias("up_capture"), share(down).alias("down_capture"))
    return d.withColumn("capture_ratio", F.try_divide("up_capture", "down_capture")).withColumn("crash_convex", (F.col("up_capture") > 0) & (F.col("down_capture") >= 0) & (F.col("down_capture") < F.col("up_capture")))


def brinson(book: DataFrame) -> DataFrame:
    """(period, sector, allocation, selection, interaction) from (period, sector, w, r, bw, br): nulls count as zero."""
    z = {x: F.coalesce(x, F.lit(0.0)) for x in ("w", "r", "bw", "br")}
    total = F.sum(z["bw"] * z["br"]).over(Window.partitionBy("period"))
    return book.select("period", "sector", ((z["w"] - z["bw"]) * (z["br"] - total)).alias("allocation"), (z["bw"] * (z["r"] - z["br"])).alias("selection"), ((z["w"] - z["bw"]) * (z["r"] - z["br"])).alias("interaction"))


def theta_exposure(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """Win rate, first autocorrelation and the exposure they point to; neutral under 50 rows."""
    d = returns.where("r is not null").withColumn("l", F.lag("r").over(along(key)))
    d = d.groupBy(key).agg(F.count("r").alias("n"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate"), F.corr(F.when(F.col("l").isNotNull(), F.col("r")), F.col("l")).alias("ac1"))
    w, c = F.col("win_rate"), F.col("ac1")
    return d.withColumn("exposure", F.when(F.col("n") < 50, "neutral").when((w > 0.55) & (F.abs(c) < 0.1), "positive_theta").when((w < 0.45) & (c > 0), "negative_theta").otherwise("neutral"))


def hashed_bootstrap(returns: DataFrame, draws: int, block: int | DataFrame, key: str = "run_id") -> DataFrame:
    """(key, draw, n, mean, sd): circular-block resamples of every key's returns, from prefix sums of r and of its square
    around the key's mean; block starts are a digest of (draw, block), so every engine and every retry draws the same.
    block: one length, or a table (key, block)."""
    mean = F.avg("r").over(Window.partitionBy(key))
    rows = numbered(returns.where("r is not null").withColumn("mu", mean), [key])
    rows = rows.select(key, "i", (F.col("r") - F.col("mu")).alias("d"), ((F.col("r") - F.col("mu")) * (F.col("r") - F.col("mu"))).alias("q"), "mu")
    sizes = family_sizes(rows, [key])
    if not isinstance(block, int):
        sizes, block = sizes.join(block.select(key, F.col("block").alias("_len")), key), F.col("_len")
    sums = block_sums(rows, [key], ["d", "q"], circular_blocks(sizes, draws, block).select(key, "n", "draw", "start", "len"))
    sums = sums.join(rows.groupBy(key).agg(F.first("mu").alias("mu")), key)
    n, d = F.col("n"), F.col("d")
    var = F.when(n > 1, F.greatest(F.col("q") - d * d / n, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))
    return sums.select(key, "draw", "n", (F.col("mu") + d / n).alias("mean"), F.sqrt(F.when(var > 1e-24, var).otherwise(F.when(n > 1, 0.0))).alias("sd"))


def optimal_block(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, block): the block length that Politis and White's rule takes from the autocorrelations.

    The first lag after which a run of lags is under twice the root of log10(n) / n, doubled, is the width of a cosine-weighted sum;
    where there is none it is half of the lags looked at. At least 1 and at most half of the returns.
    """
    of = Window.partitionBy(key)
    d = numbered(returns.where("r is not null"), [key]).withColumn("n", F.count("*").over(of)).withColumn("e", F.col("r") - F.avg("r").over(of))
    calm = F.greatest(F.lit(5), F.ceil(F.log10("n")))
    d = d.withColumn("calm", calm).withColumn("lags", F.least(F.floor(F.col("n") / 3), F.greatest(F.lit(50), 2 * F.col("calm"))).cast("long"))
    c = lagged_products(d, key, "lags").groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("c"))
    d = d.groupBy(key).agg(F.first("n").alias("n"), F.first("calm").alias("calm"), F.first("lags").alias("lags"), F.sum(F.col("e") * F.col("e")).alias("c0")).join(c, key, "left")
    n, lags = F.col("n"), F.col("lags")
    bound = 2 * F.sqrt(F.log10(n) / n)
    quiet = lambda m: F.forall(F.slice("c", (m + 1).cast("int"), F.col("calm").cast("int")), lambda x: F.abs(x / F.col("c0")) < bound)
    first = F.when(lags - F.col("calm") >= 1, F.array_min(F.filter(F.sequence(F.lit(1).cast("long"), lags - F.col("calm")), quiet)))
    d = d.withColumn("m", F.least(2 * F.coalesce(first, F.floor(lags / 2)), lags))
    weighed = lambda f: F.aggregate(F.sequence(F.lit(1).cast("long"), F.col("m")), F.lit(0.0), lambda a, k: a + (1 + F.cos(F.lit(math.pi) * k / F.col("m"))) * f(k) * F.element_at("c", k.cast("int")))
    d = d.withColumn("g", F.when(F.col("m") >= 1, weighed(lambda k: k))).withColumn("g0", F.when(F.col("m") >= 1, F.col("c0") + weighed(lambda k: F.lit(1.0))))
    length = F.ceil(F.pow(2 * F.pow(F.col("g") / F.nullif("g0", F.lit(0.0)), F.lit(2)), F.lit(1 / 3)) * F.pow(n, F.lit(1 / 3)))
    rule = F.when(n < 20, F.floor(n / 2)).when(F.col("c0") == 0, 1).otherwise(F.least(F.coalesce(length, F.lit(1)), F.floor(n / 2)))
    return d.select(key, F.greatest(rule, F.lit(1)).cast("long").alias("block"))


def bootstrap_sharpe(returns: DataFrame, draws: int = 200, level: float = 0.95, key: str = "run_id", ppy: int = m.PPY) -> DataFrame:
    """(key, sharpe, ci_lower, ci_upper, p_positive, block): the bias-corrected and accelerated interval of the Sharpe ratio.

    Resamples are circular blocks of `optimal_block`'s length (`hashed_bootstrap`). The bias is the share of resamples under the
    ratio itself, the acceleration comes from the ratios without one return each. Under 30 returns all are 0.
    """
    clean = returns.where("r is not null")
    of, year = Window.partitionBy(key), F.sqrt(F.lit(float(ppy)))
    blocks = optimal_block(clean, key)
    s = hashed_bootstrap(clean, draws, blocks, key).select(key, (F.coalesce(F.try_divide("mean", "sd"), F.lit(0.0)) * year).alias("s")).groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    n, x = F.col("n"), F.col("r")
    d = clean.select(key, "r").withColumn("n", F.count("*").over(of)).withColumn("mu", F.avg("r").over(of)).withColumn("e", x - F.col("mu")).withColumn("q", F.sum(F.col("e") * F.col("e")).over(of)).where("n >= 30")
    # the mean and the squares around it that are left without one return
    left = F.greatest(F.col("q") - F.col("e") * F.col("e") * n / (n - 1), F.lit(0.0))
    sd = F.sqrt(left / (n - 2))
    d = d.withColumn("jack", F.when(sd > 0, (F.col("mu") - F.col("e") / (n - 1)) / sd * year).otherwise(0.0))
    d = d.withColumn("gap", F.avg("jack").over(of) - F.col("jack"))
    d = d.groupBy(key).agg(F.first(F.col("mu") / F.nullif(F.sqrt(F.col("q") / (n - 1)), F.lit(0.0)) * year).alias("sharpe"), F.sum(F.pow("gap", F.lit(3))).alias("g3"), F.sum(F.col("gap") * F.col("gap")).alias("g2"))
    d = d.join(s, key).withColumn("sharpe", F.coalesce("sharpe", F.lit(0.0)))
    share = F.size(F.filter("s", lambda v: v < F.col("sharpe"))) / F.size("s")
    edge = 1 / (F.size("s") + 1)
    d = d.withColumn("z0", stats.norm_ppf(F.greatest(F.least(share, 1 - edge), edge))).withColumn("a", F.coalesce(F.try_divide("g3", 6 * F.pow("g2", F.lit(1.5))), F.lit(0.0)))

    def quantile(alpha: float):
        z = F.col("z0") + NormalDist().inv_cdf(alpha)
        at = stats.norm_cdf(F.col("z0") + z / (1 - F.col("a") * z)) * (F.size("s") - 1)
        low = F.floor(at).cast("int")
        return F.element_at("s", low + 1) + (at - low) * (F.element_at("s", F.least(low + 2, F.size("s"))) - F.element_at("s", low + 1))

    positive = F.size(F.filter("s", lambda v: v > 0)) / F.size("s")
    d = d.select(key, "sharpe", quantile((1 - level) / 2).alias("ci_lower"), quantile((1 + level) / 2).alias("ci_upper"), positive.alias("p_positive")).join(blocks, key)
    few = clean.groupBy(key).agg(F.count("*").alias("n")).where("n < 30").select(key, *[F.lit(0.0).alias(x) for x in ("sharpe", "ci_lower", "ci_upper", "p_positive")], F.lit(None).cast("long").alias("block"))
    return d.unionByName(few)


def ruin(returns: DataFrame, drawdown: float, horizon: int, draws: int, key: str = "run_id") -> DataFrame:
    """(key, ruin): the share of resampled paths of `horizon` returns whose drawdown reaches the level."""
    rows = returns.where("r is not null").select(key, "r", (F.row_number().over(along(key)) - 1).alias("i"))
    picks = rows.groupBy(key).agg(F.count("*").alias("n")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(horizon - 1))))
    picks = picks.withColumn("i", F.conv(F.substring(F.md5(F.concat_ws(":", "draw", "pos")), 1, 8), 16, 10).cast("long") % F.col("n"))
    w = along([key, "draw"], "pos").rowsBetween(Window.unboundedPreceding, 0)
    d = picks.join(rows, [key, "i"]).withColumn("e", F.sum(F.log1p("r")).over(w)).withColumn("p", F.max("e").over(w))
    return d.groupBy(key, "draw").agg(F.min(F.expm1(F.col("e") - F.col("p"))).alias("worst")).groupBy(key).agg(F.avg((F.col("worst") <= drawdown).cast("double")).alias("ruin"))


def risk_by_regime(returns: DataFrame, level: float = 0.05, key: str = "run_id", ppy: int = m.PPY) -> DataFrame:
    """(key, regime, n, var, cvar, mean_return, vol, sharpe); regimes of under five rows are left out."""
    q = returns.groupBy(key, "regime").agg(F.percentile("r", F.lit(level)).alias("var"))
    d = returns.join(q, [key, "regime"]).groupBy(key, "regime", "var")
    d = d.agg(F.count("r").alias("n"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar"), F.avg("r").alias("mean_return"), F.stddev_samp("r").alias("vol"), m.sharpe("r", ppy).alias("sharpe"))
    return d.where("n >= 5")


def book_attribution(book: DataFrame, key: str = "run_id", ppy: int = m.PPY) -> DataFrame:
    """Return and risk contributions of (key, dt, r, w): one pass, as a name's share of risk is its covariance with the book."""
    d = book.withColumn("total", F.sum(F.col("w") * F.col("r")).over(Window.partitionBy("dt")))
    d = d.groupBy(key).agg(F.first("w").alias("weight"), F.avg("r").alias("mu"), F.covar_samp("r", "total").alias("c"), m.sharpe("r", ppy).alias("sharpe"))
    all_ = Window.partitionBy(F.lit(1))  # one row a name
    gain, risk = F.col("weight") * F.col("mu"), F.col("weight") * F.col("c")
    return d.select(key, "weight", (gain * ppy).alias("ret_contrib"), (gain / F.sum(gain).over(all_)).alias("ret_share"), (risk / F.sum(risk).over(all_)).alias("risk_share"), "sharpe")
