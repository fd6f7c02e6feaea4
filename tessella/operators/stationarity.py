"""Unit roots, level stationarity and drifting variance.

Regressions are sums of products: a key's bars are cut into blocks, each block hands on one small matrix, and only the sums are
solved, one row a key, so keys of any length are spread. Rows with a null return take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import stats

from .blocks import lagged_products
from .panel import along

#: Fixed values, MacKinnon's response surface for a constant: bounds, turning point, and the polynomials of its two branches.
TAU_MIN, TAU_MAX, TAU_STAR = -18.83, 2.74, -1.61
TAU_SMALL, TAU_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
#: Critical points of the level-stationarity statistic and their p-values.
LEVEL_POINTS, LEVEL_P = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)

LEAST = 20
BLOCK = 8192


def _bars(returns: DataFrame, key: str) -> DataFrame:
    d = returns.where("r is not null").select(key, "dt", F.col("r").cast("double").alias("r"))
    of = Window.partitionBy(key)
    d = d.withColumn("n", F.count("*").over(of)).withColumn("i", (F.row_number().over(along(key)) - 1).cast("long"))
    return d.withColumn("moves", F.max("r").over(of) > F.min("r").over(of))


def _products(rows: DataFrame, key: str, most: int) -> DataFrame:
    """(key, lags, rows, products): sums of z z' over the bars from lags + 1 on, z = (1, level before, the `lags` steps before, step).

    rows: key, i, r, step (null at a key's first bar), lags (one number a key, at most `most`).
    """
    back = along(key).rowsBetween(-most, -1)
    before = F.slice(F.reverse(F.collect_list("step").over(back)), F.lit(1), F.col("lags")) if most else F.array().cast("array<double>")
    d = rows.withColumn("level", F.lag("r").over(along(key))).withColumn("before", before).where(F.col("i") > F.col("lags"))
    d = d.select(key, "lags", F.floor(F.col("i") / BLOCK).alias("block"), F.concat(F.array(F.lit(1.0), "level"), "before", F.array("step")).alias("z"))

    def one(table: pa.Table) -> pa.Table:
        z = table.column("z").combine_chunks()
        k = table.column("lags")[0].as_py() + 3
        m = z.flatten().to_numpy().reshape(-1, k)
        return table.select([key, "lags"]).slice(0, 1).append_column("rows", pa.array([len(m)])).append_column("products", pa.array([(m.T @ m).ravel().tolist()]))

    t = rows.schema[key].dataType.simpleString()
    parts = d.groupBy(key, "lags", "block").applyInArrow(one, f"{key} {t}, lags int, rows long, products array<double>")
    n = parts.groupBy(key, "lags").agg(F.sum("rows").alias("rows"))
    cells = parts.select(key, F.posexplode("products")).groupBy(key, "pos").agg(F.sum("col").alias("v"))
    cells = cells.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("products"))
    return n.join(cells, key)


def _nested(products: np.ndarray, k: int) -> np.ndarray:
    """Residual squares of the last column on the first 1, 2, ... k - 1 others, from one elimination of the matrix of products."""
    m, out = products.reshape(k, k).copy(), []
    for j in range(k - 1):
        if m[j, j] > 1e-12 * max(products[j * k + j], 1e-300):
            m[j + 1 :] -= np.outer(m[j + 1 :, j] / m[j, j], m[j])
        out.append(m[-1, -1])
    return np.array(out)


def dickey_fuller(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, n, lags, statistic, p_value, stationary): the augmented Dickey-Fuller test with a constant.

    The number of lagged steps, up to 12 (n / 100)^(1/4) rounded up, is the one of least AIC on the bars that all may use; the
    regression with it then takes every bar it can. Nested regressions come from one matrix of products. Keys of under LEAST
    bars, or of one value throughout, have null statistics and are not stationary.
    """
    d = _bars(returns, key).withColumn("step", F.col("r") - F.lag("r").over(along(key)))
    good = d.where((F.col("n") >= LEAST) & F.col("moves")).withColumn("lags", F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2).cast("int"))
    most = good.agg(F.max("lags")).head()[0] or 0  # of the longest key

    def choose(batches):
        for b in batches:
            best = []
            for lags, n, m in zip(b.column("lags").to_pylist(), b.column("rows").to_pylist(), b.column("products").to_pylist()):
                ssr = _nested(np.array(m), lags + 3)[1:]
                aic = n * (np.log(2 * np.pi) + np.log(np.maximum(ssr, 1e-300) / n) + 1) + 2 * np.arange(2, lags + 3)
                best.append(int(np.argmin(aic)))
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(best, pa.int32())], [key, "lags"])

    def test(batches):
        for b in batches:
            out = []
            for lags, n, m in zip(b.column("lags").to_pylist(), b.column("rows").to_pylist(), b.column("products").to_pylist()):
                m = np.array(m).reshape(lags + 3, lags + 3)
                inverse = np.linalg.pinv(m[:-1, :-1])
                coef = inverse @ m[:-1, -1]
                s2 = max(m[-1, -1] - coef @ m[:-1, -1], 0.0) / max(n - lags - 2, 1)
                out.append(float(coef[1] / np.sqrt(s2 * inverse[1, 1])) if s2 * inverse[1, 1] > 0 else None)
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("lags"), pa.array(out, pa.float64())], [key, "lags", "statistic"])

    t = returns.schema[key].dataType.simpleString()
    lags = _products(good, key, most).mapInArrow(choose, f"{key} {t}, lags int")
    found = _products(good.drop("lags").join(lags, key), key, most).mapInArrow(test, f"{key} {t}, lags int, statistic double")
    out = d.groupBy(key).agg(F.first("n").alias("n")).join(found, key, "left")
    x = F.col("statistic")
    curve = lambda c: sum((F.lit(v) * x**i if i else F.lit(v)) for i, v in enumerate(c))
    p = F.when(x > TAU_MAX, 1.0).when(x < TAU_MIN, 0.0).when(x <= TAU_STAR, stats.norm_cdf(curve(TAU_SMALL))).when(x.isNotNull(), stats.norm_cdf(curve(TAU_LARGE)))
    return out.withColumn("p_value", p).withColumn("stationary", F.coalesce(F.col("p_value") < 0.05, F.lit(False)))


def _between(x: Column, points: tuple, values: tuple) -> Column:
    out = F.when(x <= points[0], values[0])
    for a, b, p, q in zip(points, points[1:], values, values[1:]):
        out = out.when(x <= b, p + (x - a) * (q - p) / (b - a))
    return out.when(x > points[-1], values[-1])


def level_stationarity(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, n, lags, statistic, p_value, stationary): the KPSS test around a constant.

    The long-run variance weighs lags evenly falling; their number follows from the autocovariances up to n^(2/9). The p-value
    lies between 0.01 and 0.1, as the published table does; stationary is p over 0.05. Keys of under LEAST bars, or of one
    value throughout, have null statistics and are not stationary.
    """
    all_ = _bars(returns, key)
    d = all_.where((F.col("n") >= LEAST) & F.col("moves")).withColumn("e", F.col("r") - F.avg("r").over(Window.partitionBy(key)))
    d = d.withColumn("s", F.sum("e").over(along(key).rowsBetween(Window.unboundedPreceding, 0))).withColumn("near", F.floor(F.pow(F.col("n"), F.lit(2 / 9))))
    size = d.groupBy(key).agg(F.first("n").alias("n"), F.sum(F.col("e") * F.col("e")).alias("c0"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    near = lagged_products(d, key, "near").groupBy(key).agg(F.sum("c").alias("s0"), F.sum(F.col("k") * F.col("c")).alias("s1"))
    tilt = 2 * F.col("s1") / (F.col("c0") + 2 * F.col("s0"))
    lags = F.least(F.floor(1.1447 * F.pow(tilt * tilt, F.lit(1 / 3)) * F.pow(F.col("n"), F.lit(1 / 3))), F.col("n") - 1)
    size = size.join(near, key).withColumn("lags", lags.cast("int"))
    weighed = lagged_products(d.join(size.select(key, "lags"), key), key, "lags").join(size.select(key, "lags"), key)
    weighed = weighed.groupBy(key).agg(F.sum(2 * F.col("c") * (1 - F.col("k") / (F.col("lags") + 1))).alias("more"))
    out = size.join(weighed, key, "left")
    out = out.select(key, "lags", F.try_divide(F.col("ss") / F.col("n"), F.col("c0") + F.coalesce("more", F.lit(0.0))).alias("statistic"))
    out = all_.groupBy(key).agg(F.first("n").alias("n")).join(out, key, "left").withColumn("p_value", _between(F.col("statistic"), LEVEL_POINTS, LEVEL_P))
    return out.withColumn("stationary", F.coalesce(F.col("p_value") > 0.05, F.lit(False)))


def drifting_variance(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, n, statistic, p_value, drifts): White's test of squared returns on a constant, time and its square.

    Keys of under LEAST bars: statistic 0, p 1. Squares that are all equal: the same.
    """
    d = _bars(returns, key).withColumn("y", F.col("r") * F.col("r"))
    # time is centred on the key's middle, which leaves the fit as it is and the sums well scaled
    t = (F.col("i") - (F.col("n") - 1) / 2) / F.col("n")
    d = d.withColumn("t", t).withColumn("u", t * t)
    m = d.groupBy(key).agg(F.first("n").alias("n"), F.var_pop("y").alias("yy"), *[F.covar_pop(a, b).alias(a + b) for a, b in ("ty", "uy", "tu", "tt", "uu")])
    c = F.col
    explained = (c("ty") * c("ty") * c("uu") - 2 * c("ty") * c("uy") * c("tu") + c("uy") * c("uy") * c("tt")) / F.nullif(c("tt") * c("uu") - c("tu") * c("tu"), F.lit(0.0))
    lm = F.when((c("n") >= LEAST) & (c("yy") > 0), c("n") * F.coalesce(explained, F.lit(0.0)) / c("yy")).otherwise(0.0)
    out = m.select(key, "n", lm.alias("statistic"))
    return out.withColumn("p_value", stats.chi2_sf_of("statistic", 2)).withColumn("drifts", F.col("p_value") < 0.05)


def stationarity_reading(unit_root: DataFrame, level: DataFrame, key: str = "run_id") -> DataFrame:
    """(key, reading): what both tests say together: stationary, unit_root, or unclear where they contradict or agree on neither."""
    both = unit_root.select(key, F.col("stationary").alias("a"), F.col("statistic").alias("x")).join(level.select(key, F.col("stationary").alias("b"), F.col("statistic").alias("y")), key)
    reading = F.when(F.col("x").isNull() | F.col("y").isNull(), "unknown").when(F.col("a") & F.col("b"), "stationary").when(~F.col("a") & ~F.col("b"), "unit_root").otherwise("unclear")
    return both.select(key, reading.alias("reading"))
