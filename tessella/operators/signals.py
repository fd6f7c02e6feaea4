"""Cross-section and signal quality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import stats

from .panel import along, islands, rolling


def avg_rank(value: str, over_keys: list[str]) -> Column:
    """Average rank of ties, as Spearman's correlation needs it."""
    w = Window.partitionBy(*over_keys).orderBy(value)
    return F.rank().over(w) + (F.count("*").over(Window.partitionBy(*over_keys, value)) - 1) / 2


def long_short(signals: DataFrame, top_k: int, both: bool = True) -> DataFrame:
    """Weights per date: 1/k on the k largest signals, -1/k on the k smallest if there are 2k names; ties by symbol."""
    w, n = Window.partitionBy("dt"), F.count("*").over(Window.partitionBy("dt"))
    d = signals.where("signal is not null").withColumn("n", n).withColumn("k", F.least(F.lit(top_k), F.col("n")))
    d = d.withColumn("rn", F.row_number().over(w.orderBy("signal", "symbol")))
    short = F.lit(both) & (F.col("n") >= 2 * F.col("k")) & (F.col("rn") <= F.col("k"))
    return d.withColumn("w", F.when(F.col("rn") > F.col("n") - F.col("k"), 1.0 / F.col("k")).when(short, -1.0 / F.col("k")).otherwise(0.0)).select("symbol", "dt", "w")


def information_coefficient(signals: DataFrame, need: int = 5) -> DataFrame:
    """(dt, ic): Spearman correlation of signal and forward return, on dates of at least `need` pairs; rounded, so that zero is zero."""
    d = signals.where("signal is not null and fwd is not null")
    d = d.withColumn("rs", avg_rank("signal", ["dt"])).withColumn("rf", avg_rank("fwd", ["dt"]))
    return d.groupBy("dt").agg(F.count("*").alias("n"), F.round(F.corr("rs", "rf"), 12).alias("ic")).where(F.col("n") >= need).select("dt", "ic")


def ic_summary(ic: DataFrame) -> DataFrame:
    sd = F.stddev_samp("ic")
    return ic.where("ic is not null").agg(F.count("*").alias("n"), F.avg("ic").alias("mean_ic"), sd.alias("std_ic"), F.try_divide(F.avg("ic"), sd).alias("icir"), (F.try_divide(F.avg("ic"), sd) * F.sqrt(F.count("*"))).alias("t_stat"), F.avg((F.col("ic") > 0).cast("double")).alias("pct_positive"))


def xi_correlation(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Chatterjee's xi: how far y is a function of x. Ties in x by dt; ranks of y count equals."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = F.count("*").over(Window.partitionBy(key).orderBy(y).rangeBetween(Window.unboundedPreceding, 0))
    left = F.count("*").over(Window.partitionBy(key).orderBy(F.desc(y)).rangeBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("r", r).withColumn("l", left).withColumn("next", F.lead("r").over(Window.partitionBy(key).orderBy(x, "dt")))
    d = d.withColumn("n", F.count("*").over(Window.partitionBy(key)))
    top, low = F.sum(F.abs(F.col("next") - F.col("r"))), F.sum(F.col("l") * (F.col("n") - F.col("l")))
    return d.groupBy(key).agg((1 - F.try_divide(F.first("n") * top * 1.0, 2.0 * low)).alias("xi"))


def xi_significance(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, xi, p_value): one-sided, from the normal limit of root n times xi with variance 2/5 under independence. Under five
    pairs: xi 0, p 1."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.groupBy(key).agg(F.count("*").alias("n")).join(xi_correlation(df, key, x, y), key)
    xi = F.when(F.col("n") >= 5, F.coalesce("xi", F.lit(0.0))).otherwise(0.0)
    return d.select(key, "n", xi.alias("xi"), F.when(F.col("n") >= 5, stats.norm_cdf(-xi * F.sqrt("n") / math.sqrt(0.4))).otherwise(1.0).alias("p_value"))


def trend_regime(prices: DataFrame, n: int = 200, key: str = "symbol") -> DataFrame:
    """(key, dt, regime): 1 where the price is above its mean over `n` bars, else 0; 0 while there are fewer."""
    mean = rolling(F.col("price"), n, along(key))
    return prices.select(key, "dt", F.coalesce((F.col("price") > mean).cast("int"), F.lit(0)).alias("regime"))


def level_regime(levels: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """levels with regime: 0 at or under `low`, 2 at or over `high`, else 1; a null level is 1."""
    v = F.col(value)
    return levels.withColumn("regime", F.when(v >= high, 2).when(v <= low, 0).otherwise(1))


def turnover(weights: DataFrame, keys: str = "dt") -> DataFrame:
    """Sum of absolute weight changes per date."""
    w = along("symbol")
    d = weights.withColumn("d", F.abs(F.col("w") - F.coalesce(F.lag("w").over(w), F.lit(0.0))))
    return d.groupBy(keys).agg(F.sum("d").alias("turnover"))


def buckets(signals: DataFrame, n: int = 5) -> DataFrame:
    """Mean forward return per ntile bucket of the signal."""
    d = signals.where("signal is not null and fwd is not null").withColumn("bucket", F.ntile(n).over(Window.partitionBy("symbol").orderBy("signal", "dt")))
    return d.groupBy("symbol", "bucket").agg(F.count("*").alias("n"), F.avg("fwd").alias("mean_fwd"))


def quantile_edges(signals: DataFrame, n: int = 5) -> DataFrame:
    """Value buckets per date: linear-interpolated quantile edges, right-closed, repeated edges dropped (not ntile)."""
    q = [i / n for i in range(n + 1)]
    edges = signals.where("signal is not null").groupBy("dt").agg(F.array_distinct(F.percentile("signal", F.array(*map(F.lit, q)))).alias("edges"))
    d = signals.where("signal is not null").join(edges, "dt")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    return d.withColumn("bucket", F.size(F.filter(inner, lambda e: e < F.col("signal"))) + 1)


def ewm_volatility(prices: DataFrame, span: int = 100, key: str = "symbol") -> DataFrame:
    """prices with `vol`: the exponentially weighted standard deviation of log returns, with the bias of the weights taken out.

    Weights are powers of the bar's place in a block of `span` bars. What a block leaves behind decays by (1 - 2 / (span + 1))
    to the power of its bars; forty blocks back it is under 1e-33 and ends there, so no weight leaves the doubles however many
    bars a key has, and each bar reads its own block's running sums and at most forty sums of blocks. Null until there are
    two returns.
    """
    w = along(key)
    q = math.log(1 - 2 / (span + 1))
    d = prices.withColumn("lr", F.log(F.col("price") / F.lag("price").over(w))).withColumn("_i", F.row_number().over(w) - 1)
    d = d.withColumn("_b", F.floor(F.col("_i") / span)).withColumn("_p", F.col("_i") - F.col("_b") * span).withColumn("_seen", F.count("lr").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    k = F.when(F.col("lr").isNotNull(), F.exp(-q * F.col("_p")))  # grows within a block by at most e * e
    parts = {"w1": k, "w2": k * k, "s1": k * F.col("lr"), "s2": k * F.col("lr") * F.col("lr")}
    own = Window.partitionBy(key, "_b").orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({x: F.coalesce(F.sum(v).over(own), F.lit(0.0)) for x, v in parts.items()})
    # sums of whole blocks, as of their first bar; those before a bar's block follow as an array, nearest last
    last = Window.partitionBy(key, "_b")
    whole = F.when(F.col("_p") == 0, F.struct(*[F.max_by(x, "_p").over(last).alias(x) for x in parts]))
    d = d.withColumn("_whole", whole).withColumn("_before", F.collect_list("_whole").over(along(key, "_b").rangeBetween(-40, -1)))
    back = lambda x, power: F.aggregate(F.col("_before"), F.lit(0.0), lambda acc, e: (acc + e[x]) * math.exp(power * q * span))
    d = d.withColumns({x: (F.col(x) + back(x, 2 if x == "w2" else 1)) for x in parts})
    mean = F.col("s1") / F.col("w1")
    var = (F.col("s2") / F.col("w1") - mean * mean) * F.col("w1") ** 2 / F.nullif(F.col("w1") ** 2 - F.col("w2"), F.lit(0.0))
    return d.withColumn("vol", F.when(F.col("_seen") >= 2, F.sqrt(F.greatest(var, F.lit(0.0))))).drop("lr", *parts, "_i", "_b", "_p", "_seen", "_whole", "_before")


def triple_barrier(prices: DataFrame, horizon: int, up: float, down: float, span: int = 100) -> DataFrame:
    """(symbol, dt, label, bars, ret): which barrier the next `horizon` closes touch first: 1, -1, or 0 at the end.

    Barriers lie `up` and `down` times the bar's exponentially weighted volatility away (zero while that is null); a multiple
    of zero or less is no barrier. The bars ahead are an array frame, so there is no self-join.
    """
    ahead = F.collect_list("price").over(along("symbol").rowsBetween(1, horizon))
    d = ewm_volatility(prices, span).withColumn("a", ahead).withColumn("vol", F.coalesce("vol", F.lit(0.0))).where(F.size("a") > 0)
    first = lambda test: F.coalesce(F.array_min(F.filter(F.transform("a", lambda x, i: F.when(test(x), i + 1)), lambda x: x.isNotNull())), F.lit(horizon + 1))
    none = F.lit(horizon + 1)
    d = d.withColumn("u", first(lambda x: x >= F.col("price") * (1 + up * F.col("vol"))) if up > 0 else none)
    d = d.withColumn("d", first(lambda x: x <= F.col("price") * (1 - down * F.col("vol"))) if down > 0 else none)
    label = F.when((F.col("u") > horizon) & (F.col("d") > horizon), 0).when(F.col("u") <= F.col("d"), 1).otherwise(-1)
    d = d.withColumn("label", label).withColumn("bars", F.least("u", "d", F.size("a")))
    return d.select("symbol", "dt", "label", "bars", (F.element_at("a", F.col("bars")) / F.col("price") - 1).alias("ret"))


def neutralise(signals: DataFrame, sector: str) -> DataFrame:
    """The signal less its sector's mean on the date."""
    return signals.withColumn("neutral", F.col("signal") - F.avg("signal").over(Window.partitionBy("dt", sector)))


def ewm(values: DataFrame, key: str, value: str, alpha: float, order: str = "dt") -> DataFrame:
    """Exponential mean without adjustment: m = alpha * x + (1 - alpha) * m, from the first value. One run's values are
    folded in order inside one group, as the recursion asks; runs are parallel."""

    def fold(pdf):
        pdf = pdf.sort_values(order)
        pdf["ewm"] = pdf[value].ewm(alpha=alpha, adjust=False).mean()
        return pdf[[key, order, "ewm"]]

    t = values.schema
    return values.select(key, order, value).groupBy(key).applyInPandas(fold, f"{key} {t[key].dataType.simpleString()}, {order} {t[order].dataType.simpleString()}, ewm double")


def regimes(returns: DataFrame, key: str, window: int = 21) -> DataFrame:
    """Volatility terciles per run of the rolling standard deviation: low, mid, high; null while it warms up."""
    d = returns.withColumn("vol", rolling(F.col("r"), window, along(key), F.stddev_samp))
    q = d.groupBy(key).agg(F.percentile("vol", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("q"))
    d = d.join(q, key)
    v = F.col("vol")
    return d.withColumn("regime", F.when(v.isNull(), None).when(v <= F.col("q")[0], "low").when(v <= F.col("q")[1], "mid").otherwise("high")).drop("q")



def market_regimes(prices: DataFrame, key: str = "symbol", trend: int = 200, window: int = 63, calm: float = 0.12, stress: float = 0.2, ppy: int = 252) -> DataFrame:
    """(key, dt, regime): trend against the long mean and volatility band of the bar before; Bear-Mid while the mean warms up."""
    w = along(key)
    d = prices.withColumn("_r", F.coalesce(F.col("price") / F.lag("price").over(w) - 1, F.lit(0.0)))
    d = d.withColumn("_m", rolling(F.col("price"), trend, w)).withColumn("_v", rolling(F.col("_r"), window, w, F.stddev_samp) * F.sqrt(F.lit(float(ppy))))
    band = F.when(F.col("_v") <= calm, "-Calm").when(F.col("_v") >= stress, "-Stress").otherwise("-Mid")
    now = F.when(F.col("_m").isNull(), "Bear-Mid").otherwise(F.concat(F.when(F.col("price") > F.col("_m"), "Bull").otherwise("Bear"), band))
    return d.withColumn("_now", now).select(key, "dt", F.coalesce(F.lag("_now").over(w), F.lit("Bear-Mid")).alias("regime"))


def timeline(labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, label, start_dt, end_dt, bars) of every stretch of one label."""
    d = islands(labels, key, label)
    return d.groupBy(key, "island", label).agg(F.min("dt").alias("start_dt"), F.max("dt").alias("end_dt"), F.count("*").alias("bars")).drop("island")
