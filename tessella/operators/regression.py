"""Least squares over long tables: products are summed in Spark, one row a key; only those k x k sums are solved in Python."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import stats

from .panel import along

TERMS = "n long, r2 double, terms array<struct<term: string, coef: double, se: double>>"


def _moments(xs: list[str], y: str) -> list:
    every = ["1", *xs, y]
    value = lambda x: F.lit(1.0) if x == "1" else F.col(x)
    return [F.sum(value(a) * value(b)).alias(f"_m{i}_{j}") for i, a in enumerate(every) for j, b in enumerate(every) if i <= j]


def _square(row, name: str, k: int) -> np.ndarray:
    out = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[f"{name}{i}_{j}"]
    return out


def ols(df: DataFrame, key: str, y: str, xs: list[str], lags: int | None = None) -> DataFrame:
    """(key, n, r2, terms): coefficients of y on a constant and xs with standard errors.

    With `lags` the errors are Newey-West's: the scores of every row and of the rows before it (by dt) are multiplied and
    summed in a second pass. Rows with a null take no part; keys of fewer rows than terms give nothing. A singular design
    is solved in the least-squares sense.
    """
    k = len(xs) + 1
    t = df.schema[key].dataType.simpleString()
    d = df.select(key, "dt", *[F.col(x).cast("double").alias(x) for x in (*xs, y)]).dropna(subset=[*xs, y])
    sums = d.groupBy(key).agg(*_moments(xs, y))
    names = ["const", *xs]

    def coefficients(row):
        m = _square(row, "_m", k + 1)
        inverse = np.linalg.pinv(m[:k, :k])
        b = inverse @ m[:k, k]
        n, rest = m[0, 0], max(m[k, k] - b @ m[:k, k], 0.0)
        spread = m[k, k] - m[0, k] ** 2 / n
        return n, inverse, b, rest, 1 - rest / spread if spread > 0 else 0.0

    def solve(batches):
        for pdf in batches:
            rows = []
            for row in pdf.to_dict("records"):
                n, inverse, b, rest, r2 = coefficients(row)
                if n < k:
                    continue
                meat = rest / max(n - k, 1) * np.linalg.pinv(inverse) if lags is None else _square(row, "_s", k)
                se = np.sqrt(np.maximum(np.diag(inverse @ meat @ inverse), 0))
                rows.append((row[key], int(n), r2, [dict(term=x, coef=float(c), se=float(s)) for x, c, s in zip(names, b, se)]))
            yield type(pdf)(rows, columns=[key, "n", "r2", "terms"])

    if lags is not None:
        def fitted(batches):
            for pdf in batches:
                yield type(pdf)([(row[key], coefficients(row)[2].tolist()) for row in pdf.to_dict("records")], columns=[key, "_b"])

        e = d.join(sums.mapInPandas(fitted, f"{key} {t}, _b array<double>"), key)
        fit = sum((F.col("_b")[i + 1] * F.col(x) for i, x in enumerate(xs)), F.col("_b")[0])
        w = along(key)
        e = e.withColumn("_e", F.col(y) - fit)
        e = e.select(key, "dt", *[((F.lit(1.0) if x == "const" else F.col(x)) * F.col("_e")).alias(f"_u{i}") for i, x in enumerate(names)])
        e = e.select("*", *[F.lag(f"_u{i}", g).over(w).alias(f"_u{i}_{g}") for i in range(k) for g in range(1, lags + 1)])
        weight = lambda g: 1 - g / (lags + 1.0)
        cross = lambda i, j, g: F.coalesce(F.sum(F.col(f"_u{i}") * F.col(f"_u{j}_{g}") + F.col(f"_u{j}") * F.col(f"_u{i}_{g}")), F.lit(0.0)) * weight(g)
        meat = [sum((cross(i, j, g) for g in range(1, lags + 1)), F.sum(F.col(f"_u{i}") * F.col(f"_u{j}"))).alias(f"_s{i}_{j}") for i in range(k) for j in range(i, k)]
        sums = sums.join(e.groupBy(key).agg(*meat), key)
    return sums.mapInPandas(solve, f"{key} {t}, {TERMS}")


def terms(fits: DataFrame, key: str) -> DataFrame:
    """One row per coefficient, with its t statistic."""
    d = fits.select(key, "n", "r2", F.inline("terms"))
    return d.withColumn("t", F.try_divide("coef", "se"))


def vif(df: DataFrame, xs: list[str]) -> DataFrame:
    """(term, vif): what regressing every column on the others says of its variance."""
    one = df.withColumn("_all", F.lit(1))
    out = [ols(one, "_all", x, [z for z in xs if z != x]).select(F.lit(x).alias("term"), F.when(F.col("r2") < 1, 1 / (1 - F.col("r2"))).otherwise(float("inf")).alias("vif")) for x in xs]
    first, *more = out
    for x in more:
        first = first.unionByName(x)
    return first


def gamma_exposure(df: DataFrame, key: str, r: str, market: str, threshold: float = 1.96) -> DataFrame:
    """(key, gamma, t, exposure): curvature of returns against the market's; neutral under 50 rows."""
    d = df.withColumn("_sq", F.col(market) ** 2)
    d = terms(ols(d, key, r, [market, "_sq"]), key).where("term = '_sq'")
    strong = (F.col("n") >= 50) & (F.abs("t") > threshold)
    return d.select(key, F.col("coef").alias("gamma"), "t", F.when(strong & (F.col("coef") > 0), "long_gamma").when(strong, "short_gamma").otherwise("neutral").alias("exposure"))


#: The payoff that each pair of gamma and theta exposures points to.
PAYOFFS = {
    ("short_gamma", "positive_theta"): "covered_call",
    ("short_gamma", "neutral"): "short_straddle",
    ("short_gamma", "negative_theta"): "short_put",
    ("long_gamma", "negative_theta"): "long_straddle",
    ("long_gamma", "neutral"): "collar",
    ("long_gamma", "positive_theta"): "long_call",
    ("neutral", "positive_theta"): "income",
    ("neutral", "negative_theta"): "trend_following",
    ("neutral", "neutral"): "linear",
}


def payoff(gamma: DataFrame, theta: DataFrame, key: str) -> DataFrame:
    """(key, payoff, confidence) from the exposures of both."""
    names = F.create_map(*[F.lit(x) for (g, t), p in PAYOFFS.items() for x in (f"{g}/{t}", p)])
    d = gamma.select(key, "t", F.col("exposure").alias("g")).join(theta.select(key, F.col("exposure").alias("th")), key)
    return d.select(key, F.coalesce(names[F.concat_ws("/", "g", "th")], F.lit("unclassified")).alias("payoff"), F.least(F.lit(1.0), F.abs("t") / 3).alias("confidence"))


def arch_test(returns: DataFrame, lags: int = 5, key: str = "run_id") -> DataFrame:
    """(key, lm, p_value): squared deviations against their own past."""
    d = returns.where("r is not null").withColumn("_y", (F.col("r") - F.avg("r").over(Window.partitionBy(key))) ** 2)
    d = d.select(key, "dt", "_y", *[F.lag("_y", g).over(along(key)).alias(f"_y{g}") for g in range(1, lags + 1)])
    d = ols(d, key, "_y", [f"_y{g}" for g in range(1, lags + 1)]).withColumn("lm", F.col("n") * F.col("r2"))
    return d.select(key, "lm", stats.chi2_sf_of("lm", lags).alias("p_value"))


def crisis_verdict(returns: DataFrame, windows: DataFrame, key: str = "run_id", ppy: int = 252) -> DataFrame:
    """(key, whole, crisis, ratio, verdict): mean Sharpe of the windows (label, start_dt, end_dt) of five rows or more against the whole.

    The windows are a stated, short list.
    """
    s = lambda: F.try_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(float(ppy)))
    full = returns.groupBy(key).agg(s().alias("whole"))
    inside = returns.join(F.broadcast(windows), F.col("dt").between(F.col("start_dt"), F.col("end_dt"))).groupBy(key, "label").agg(F.count("r").alias("n"), s().alias("s")).where("n >= 5")
    d = full.join(inside.groupBy(key).agg(F.avg("s").alias("crisis"), F.count("s").alias("windows")), key, "left").withColumn("ratio", F.try_divide("crisis", "whole"))
    r = F.col("ratio")
    return d.withColumn("verdict", F.when(r.isNull(), "INSUFFICIENT_DATA").when(F.col("whole") <= 0, "NEGATIVE_EDGE").when(r > 1.5, "CONVEXITY_CANDIDATE").when(r >= 0.7, "ROBUST_TO_CRISES").when(r >= 0.3, "MIXED").otherwise("VOL_RISK_PREMIUM_CANDIDATE"))


def market_buckets(df: DataFrame, r: str, market: str, n: int = 7) -> DataFrame:
    """(bucket, rows, market_mean, mean): returns by quantile of the market's; equal edges are one."""
    edges = df.agg(F.percentile(market, F.array(*[F.lit(i / n) for i in range(1, n)])).alias("edges"))  # one row
    d = df.crossJoin(F.broadcast(edges)).withColumn("bucket", F.size(F.filter(F.array_distinct("edges"), lambda e: e < F.col(market))))
    return d.groupBy("bucket").agg(F.count("*").alias("rows"), F.avg(market).alias("market_mean"), F.avg(r).alias("mean"))


def monotonicity(buckets: DataFrame, value: str, bucket: str, ppy: int = 252) -> DataFrame:
    """One row: rank correlation of the buckets' means with their order, the spread of the outer two, whether every step has one sign."""
    d = buckets.groupBy(bucket).agg(F.avg(value).alias("m"))
    one = Window.partitionBy(F.lit(1))  # one row a bucket
    d = d.withColumn("a", F.rank().over(one.orderBy(bucket)).cast("double")).withColumn("b", F.rank().over(one.orderBy("m")).cast("double")).withColumn("step", F.col("m") - F.lag("m").over(one.orderBy(bucket)))
    strict = (F.min("step") > 0) | (F.max("step") < 0)
    return d.agg(F.count("*").alias("groups"), F.corr("a", "b").alias("rho"), ((F.max_by("m", "a") - F.min_by("m", "a")) * ppy).alias("spread"), strict.alias("strict"))
