"""Hidden-state regimes: Gaussian states behind each key's returns, fitted by expectation and maximisation.

A key's returns in order are one group's array (a run of bars); keys are parallel. Within a group all prefixes that a walk-forward
needs are fitted side by side, one array operation a bar and round, so refitting costs rounds x bars steps, not refits times that.
States are numbered by the mean return of the bars that they label, from the lowest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def start(x: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per prefix: even chances, states that last nine bars in ten, means at even quantiles, variances of a quarter of the whole
    and up, so that no two states begin alike."""
    b = len(ends)
    pi, a = np.full((b, k), 1 / k), np.full((b, k, k), 0.1 / (k - 1))
    a[:, np.arange(k), np.arange(k)] = 0.9
    mean = np.stack([np.quantile(x[:e], (np.arange(k) + 0.5) / k) for e in ends])
    var = np.stack([x[:e].var() * np.linspace(0.25, 1.75, k) for e in ends])
    return pi, a, mean, np.maximum(var, 1e-12)


def _density(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """(bars, prefixes, states): logarithms."""
    return -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None, None] - mean[None]) ** 2 / var[None])


def maximise(x: np.ndarray, ends: np.ndarray, params: tuple) -> tuple[tuple, np.ndarray]:
    """One round for every prefix: new parameters, and the log-likelihood of the ones given."""
    pi, a, mean, var = params
    n, b, k = len(x), *pi.shape
    log = _density(x, mean, var)
    top = log.max(axis=2, keepdims=True)
    e, here = np.exp(log - top), np.arange(n)[:, None] < ends[None]
    f, c = np.empty((n, b, k)), np.ones((n, b))
    for t in range(n):
        v = (pi if t == 0 else np.einsum("bi,bij->bj", f[t - 1], a)) * e[t]
        c[t] = v.sum(1)
        f[t] = v / c[t][:, None]
    back, pairs, g = np.ones((b, k)), np.zeros((b, k, k)), np.empty((n, b, k))
    for t in range(n - 1, -1, -1):
        g[t] = f[t] * back
        inner = here[t] & (t > 0)
        if t:
            w = e[t] * back / c[t][:, None]
            pairs += np.where(inner[:, None, None], f[t - 1][:, :, None] * a * w[:, None, :], 0)
            back = np.where(here[t][:, None], np.einsum("bij,bj->bi", a, w), 1.0)
    g *= here[:, :, None]
    total = np.maximum(g.sum(0), 1e-300)
    mean = (g * x[:, None, None]).sum(0) / total
    var = np.maximum((g * (x[:, None, None] - mean[None]) ** 2).sum(0) / total, 1e-12)
    ll = ((np.log(c) + top[:, :, 0]) * here).sum(0)
    return (g[0], pairs / np.maximum(pairs.sum(2, keepdims=True), 1e-300), mean, var), ll


def fit(x: np.ndarray, ends: np.ndarray, k: int, rounds: int, gain: float = 1e-6) -> tuple[tuple, np.ndarray]:
    """Parameters of every prefix, and the log-likelihoods before each round; ends early once no prefix gains more."""
    params, seen = start(x, ends, k), []
    for _ in range(rounds):
        after, ll = maximise(x, ends, params)
        seen.append(ll)
        if len(seen) > 1 and (seen[-1] - seen[-2]).max() < gain:
            break
        params = after
    return params, np.array(seen)


def paths(x: np.ndarray, params: tuple) -> np.ndarray:
    """(bars, prefixes): the likeliest states, under every prefix's parameters, of all of x; ties go to the lower state."""
    pi, a, mean, var = params
    with np.errstate(divide="ignore"):
        log, trans, v = _density(x, mean, var), np.log(a), np.log(pi)
    came = np.zeros((len(x), *pi.shape), np.int8)
    for t in range(len(x)):
        if t:
            score = v[:, :, None] + trans
            came[t] = score.argmax(1)
            v = score.max(1)
        v = v + log[t]
    out = np.empty((len(x), len(pi)), np.int8)
    out[-1] = v.argmax(1)
    for t in range(len(x) - 1, 0, -1):
        out[t - 1] = np.take_along_axis(came[t], out[t][:, None], axis=1)[:, 0]
    return out


def ranks(x: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """The number that each state gets by the mean of the bars that it labels; states without bars come last."""
    means = [x[labels == s].mean() if (labels == s).any() else np.inf for s in range(k)]
    out = np.empty(k, np.int32)
    out[np.argsort(means, kind="stable")] = np.arange(k)
    return out


def hidden_regimes(returns: DataFrame, key: str = "run_id", states: tuple[int, ...] = (2, 3, 4), rounds: int = 50) -> DataFrame:
    """(key, dt, regime, states, log_likelihood, bic): the likeliest regime of every bar, from 0 for the lowest mean.

    Of the numbers of states the one of least BIC is taken, with k * k + k - 1 parameters. Null returns take no part; keys of
    under 100 returns, or of one value throughout, are left out.
    """

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("dt")
        x = table.column("r").to_numpy()
        best = None
        if len(x) >= 100 and x.min() < x.max():
            for k in states:
                params, seen = fit(x, np.array([len(x)]), k, rounds)
                bic = -2 * seen[-1, 0] + (k * k + k - 1) * np.log(len(x))
                if best is None or bic < best[0]:
                    best = bic, k, params, seen[-1, 0]
        if best is None:
            table, labels, best = table.slice(0, 0), np.zeros(0, np.int32), (0.0, 0, None, 0.0)
        else:
            raw = paths(x, best[2])[:, 0]
            labels = ranks(x, raw, best[1])[raw]
        same = lambda v, t: pa.array([v] * len(labels), t)
        columns = [table.column(key), table.column("dt"), pa.array(labels, pa.int32()), same(best[1], pa.int32()), same(float(best[3]), pa.float64()), same(float(best[0]), pa.float64())]
        return pa.table(columns, [key, "dt", "regime", "states", "log_likelihood", "bic"])

    t = returns.schema
    d = returns.where("r is not null").select(key, "dt", F.col("r").cast("double").alias("r"))
    return d.groupBy(key).applyInArrow(one, f"{key} {t[key].dataType.simpleString()}, dt {t['dt'].dataType.simpleString()}, regime int, states int, log_likelihood double, bic double")


def walked_regimes(returns: DataFrame, key: str = "run_id", states: int = 2, history: int = 504, refit: int = 21, rounds: int = 30) -> DataFrame:
    """(key, dt, regime, refits): regimes without a look ahead: every `refit` bars from `history` on, the model is fitted on all
    bars before and labels the next ones; earlier bars are -1.

    The bars that a model labels are taken by themselves, from its chances of the first state. A key of under history + refit returns
    is -1 throughout, with no refits.
    """

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("dt")
        x = table.column("r").to_numpy()
        labels, ends = np.full(len(x), -1, np.int32), np.zeros(0, int)
        if len(x) >= history + refit and x.min() < x.max():
            ends = np.arange(history, len(x), refit)
            params, _ = fit(x[: ends[-1]], ends, states, rounds)
            past = paths_of_prefixes(x, ends, params)
            for i, e in enumerate(ends):
                own = tuple(p[i : i + 1] for p in params)
                labels[e : e + refit] = ranks(x[:e], past[i], states)[paths(x[e : e + refit], own)[:, 0]]
        return pa.table([table.column(key), table.column("dt"), pa.array(labels), pa.array([len(ends)] * len(labels), pa.int32())], [key, "dt", "regime", "refits"])

    t = returns.schema
    d = returns.where("r is not null").select(key, "dt", F.col("r").cast("double").alias("r"))
    return d.groupBy(key).applyInArrow(one, f"{key} {t[key].dataType.simpleString()}, dt {t['dt'].dataType.simpleString()}, regime int, refits int")


def paths_of_prefixes(x: np.ndarray, ends: np.ndarray, params: tuple) -> list[np.ndarray]:
    """The likeliest states of each prefix under its own parameters."""
    return [paths(x[:e], tuple(p[i : i + 1] for p in params))[:, 0] for i, e in enumerate(ends)]
