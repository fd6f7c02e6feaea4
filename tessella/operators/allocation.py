"""Portfolio weights and searches over long returns (run_id, dt, r).

Spark reduces the returns to pairwise covariances; a book of at most `MAX_NAMES` names is then solved in one group, books
in parallel. Larger books are refused, since their matrix would not be small.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m

from . import book_search
from .portfolio import covariances

MAX_NAMES = 1000


def complete(returns: DataFrame, key: str = "run_id") -> DataFrame:
    """The rows of the dates on which every run has a return."""
    names = returns.where("r is not null").agg(F.count_distinct(key).alias("names"))
    d = returns.where("r is not null").withColumn("here", F.count("*").over(Window.partitionBy("dt")))
    return d.join(F.broadcast(names), F.col("here") == F.col("names")).select(*returns.columns)


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with non-negative entries that sum to one."""
    u = np.sort(v)[::-1]
    excess = np.cumsum(u) - 1
    k = np.flatnonzero(u * np.arange(1, len(u) + 1) > excess)[-1]
    return np.maximum(v - excess[k] / (k + 1), 0)


def min_variance(cov: np.ndarray, steps: int = 1000) -> np.ndarray:
    w, rate = np.full(len(cov), 1 / len(cov)), 1 / (2 * max(np.linalg.eigvalsh(cov)[-1], 1e-18))
    for _ in range(steps):
        w = simplex(w - rate * 2 * cov @ w)
    return w


def risk_parity(cov: np.ndarray, steps: int = 500) -> np.ndarray:
    """Equal risk contributions, by cyclical coordinate descent of w'Cw / 2 - sum(log w) / n."""
    n = len(cov)
    w = 1 / np.sqrt(np.maximum(np.diag(cov), 1e-18)) / n
    for _ in range(steps):
        old = w.copy()
        for i in range(n):
            rest = cov[i] @ w - cov[i, i] * w[i]
            w[i] = (-rest + np.sqrt(rest**2 + 4 * cov[i, i] / n)) / (2 * cov[i, i])
        if np.abs(w - old).max() < 1e-12 * np.abs(w).max():
            break
    return w / w.sum()


def max_sharpe(cov: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """The long-only portfolio of highest mean over risk; equal weights where no mean is positive.

    Up to scale it solves C z = mean on the names held, while names left out would lower the ratio (mean <= C z). The name
    that would gain most comes in, names that a solve turns negative go out, until both hold.
    """
    z, free = np.zeros(len(mean)), np.zeros(len(mean), bool)
    for _ in range(10 * len(mean)):
        gain = np.where(free, -np.inf, mean - cov @ z)
        if gain.max() <= 1e-12 * np.abs(mean).max():
            break
        free[gain.argmax()] = True
        while True:
            target = np.zeros(len(mean))
            target[free] = np.linalg.lstsq(cov[np.ix_(free, free)], mean[free], rcond=None)[0]
            if (target[free] > 0).all():
                z = target
                break
            falling = free & (target <= 0)
            step = (z[falling] / (z[falling] - target[falling])).min()
            z = z + step * (target - z)
            free &= z > 1e-15
            z[~free] = 0
    return z / z.sum() if z.sum() > 0 else np.full(len(z), 1 / len(z))


def _leaf_order(corr: np.ndarray) -> list[int]:
    """Names in the order in which single linkage joins them."""
    far = np.sqrt(np.maximum(0.5 * (1 - corr), 0))
    groups = [[i] for i in range(len(corr))]
    while len(groups) > 1:
        a, b = min(itertools.combinations(range(len(groups)), 2), key=lambda p: far[np.ix_(groups[p[0]], groups[p[1]])].min())
        groups[a] += groups.pop(b)
    return groups[0]


def hierarchical(cov: np.ndarray) -> np.ndarray:
    """Halves the linkage order again and again, splitting weight by the halves' inverse variances."""
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-18))
    w, todo = np.ones(len(cov)), [_leaf_order(cov / np.outer(sd, sd))]

    def variance(part):
        c = cov[np.ix_(part, part)]
        inner = 1 / np.diag(c)
        inner = inner / inner.sum()
        return inner @ c @ inner

    while todo:
        part = todo.pop()
        if len(part) > 1:
            left, right = part[: len(part) // 2], part[len(part) // 2 :]
            a, b = variance(left), variance(right)
            w[left] *= b / (a + b)
            w[right] *= a / (a + b)
            todo += [left, right]
    return w


METHODS = {
    "min_variance": lambda c, mu: min_variance(c),
    "risk_parity": lambda c, mu: risk_parity(c),
    "max_sharpe": max_sharpe,
    "hierarchical": lambda c, mu: hierarchical(c),
    "inverse_vol": lambda c, mu: (1 / np.sqrt(np.diag(c))) / (1 / np.sqrt(np.diag(c))).sum(),
}


def weights(returns: DataFrame, methods: tuple[str, ...] = tuple(METHODS)) -> DataFrame:
    """(method, run_id, w) of one book by each method, from the dates on which all its runs have a return."""
    d = complete(returns)
    mean = d.groupBy(F.col("run_id").alias("a_id")).agg(F.avg("r").alias("mean"))
    pairs = covariances(d).join(mean, "a_id").withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    name = returns.schema["run_id"].dataType.simpleString()

    def solve(p):
        c = p.pivot(index="a_id", columns="b_id", values="cov").sort_index()
        if len(c) > MAX_NAMES:
            raise ValueError(f"a book of {len(c)} names; at most {MAX_NAMES} are solved at once")
        mu = p.drop_duplicates("a_id").set_index("a_id")["mean"].reindex(c.index).to_numpy()
        return pd.DataFrame({"method": p.method.iloc[0], "run_id": c.index, "w": METHODS[p.method.iloc[0]](c[c.index].to_numpy(), mu)})

    return pairs.groupBy("method").applyInPandas(solve, f"method string, run_id {name}, w double")


def diversification(returns: DataFrame, book: DataFrame) -> DataFrame:
    """Weighted mean volatility over the book's volatility, from pairwise covariances. book: run_id, w."""
    a, b = (book.select(F.col("run_id").alias(f"{k}_id"), F.col("w").alias(f"w{k}")) for k in "ab")
    c = covariances(returns).join(a, "a_id").join(b, "b_id")
    own = F.when(F.col("a_id") == F.col("b_id"), F.col("wa") * F.sqrt("cov"))
    return c.agg(F.sum(own).alias("sum_vol"), F.sqrt(F.sum(F.col("wa") * F.col("wb") * F.col("cov"))).alias("book_vol")).withColumn("ratio", F.col("sum_vol") / F.col("book_vol"))


def _scored(returns: DataFrame, samples: DataFrame) -> DataFrame:
    """(sample, n, sharpe): every sample's book on the dates on which all runs have a return. samples: sample, run_id, w."""
    d = complete(returns).join(samples, "run_id").groupBy("sample", "dt").agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    return d.groupBy("sample").agg(F.count("*").alias("n"), m.sharpe("r").alias("sharpe"))


def weight_grid(names: DataFrame, parts: int = 10) -> DataFrame:
    """(sample, run_id, w): all weights that are multiples of 1 / parts. names: run_id of one small book."""
    ids = [r[0] for r in names.select("run_id").distinct().orderBy("run_id").limit(13).collect()]
    if len(ids) > 12:
        raise ValueError("an even grid is for at most 12 names; draw samples for larger books")
    bars = itertools.combinations(range(parts + len(ids) - 1), len(ids) - 1)
    rows = [(s, i, (b - a - 1) / parts) for s, cut in enumerate(bars) for i, a, b in zip(ids, (-1, *cut), (*cut, parts + len(ids) - 1))]
    return names.sparkSession.createDataFrame(rows, f"sample int, run_id {names.schema['run_id'].dataType.simpleString()}, w double")


def search_weights(returns: DataFrame, samples: DataFrame) -> DataFrame:
    """Scores of all samples; join with `samples` for the weights."""
    return _scored(returns, samples)


def search_subsets(returns: DataFrame, most: int = 12) -> DataFrame:
    """(sample, names, n, sharpe) of every equal-weight subset of a book of at most `most` names; sample is the subset's bit mask."""
    names = returns.select("run_id").distinct()
    ranked = names.withColumn("bit", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("run_id")) - 1)
    n = ranked.agg(F.count("*").alias("n")).select(F.when(F.col("n") <= most, F.col("n")).otherwise(F.raise_error(F.lit("too many names for all subsets"))).alias("n"))
    masks = n.select(F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), "n") - 1).cast("int"))).alias("sample"))
    picked = ranked.join(masks, F.expr("shiftright(sample, bit) % 2 = 1")).withColumn("names", F.bit_count("sample"))
    samples = picked.select("sample", "run_id", (1.0 / F.col("names")).alias("w"))
    return _scored(returns, samples).withColumn("names", F.bit_count("sample"))


def multi_kelly(returns: DataFrame, family: str, name: str = "run_id") -> DataFrame:
    """(family, name, kelly, shrunk): growth-optimal fractions of a family's names, and those shrunk for what the sample cannot know.

    kelly is the inverse covariance times the mean, a negative one a short; shrunk multiplies it by T p / (T p + N + 2), p the
    squared Sharpe of the sample. Dates with all names count. Both are 0 where the covariance is singular; shrunk also where there
    are no more than N + 2 dates. Means and products are summed in Spark, and one small matrix a family is solved.
    """
    moments = book_search.moments(book_search.dated(returns, family, name), family, 1)
    names = returns.groupBy(family).agg(F.array_sort(F.collect_set(name)).alias("names"))
    d = moments.join(names, family).select(family, "names", F.col("moments")[0].alias("m")).select(family, "names", "m.n", "m.s", "m.q")

    def solve(frames):
        for p in frames:
            full, shrunk = [], []
            for n, s, q in zip(p["n"], p["s"], p["q"]):
                k, mu = len(s), np.array(s) / n
                f, less = np.zeros(k), np.zeros(k)
                cov = (np.array(q).reshape(k, k) - n * np.outer(mu, mu)) / max(n - 1, 1)
                if n > 1 and np.linalg.matrix_rank(cov) == k:
                    f = np.linalg.solve(cov, mu)
                    squared = float(mu @ f)
                    if n > k + 2 and squared > 0:
                        less = f * (n * squared / (n * squared + k + 2))
                full.append(f.tolist())
                shrunk.append(less.tolist())
            yield p[[family, "names"]].assign(kelly=full, shrunk=shrunk)

    t = returns.schema
    out = d.mapInPandas(solve, f"{family} {t[family].dataType.simpleString()}, names array<{t[name].dataType.simpleString()}>, kelly array<double>, shrunk array<double>")
    return out.select(family, F.inline(F.arrays_zip("names", "kelly", "shrunk"))).toDF(family, name, "kelly", "shrunk")


def throttle(returns: DataFrame, key: str = "run_id", trigger: float = 0.1, scale: float = 0.5) -> DataFrame:
    """(key, dt, r): returns scaled down from the day after the throttled equity's drawdown reaches the trigger until its next peak.

    The equity that decides is the one that the throttle makes, so every key's days are folded in order; keys are parallel.
    """

    def fold(pdf):
        pdf = pdf.sort_values("dt")
        out, equity, peak, on = [], 1.0, 1.0, False
        for r in pdf["r"].to_numpy(float):
            out.append(r * scale if on else r)
            equity *= 1 + out[-1]
            peak = max(peak, equity)
            on = equity / peak - 1 <= -trigger or (on and equity < peak)
        return pdf.assign(r=out)

    d = returns.where("r is not null").select(key, "dt", "r")
    return d.groupBy(key).applyInPandas(fold, d.schema)
