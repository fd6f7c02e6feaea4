"""Stationarity tests, tail fits, sequential draws and clusters against plain NumPy forms."""

import datetime
import hashlib
import math
from collections import Counter
from statistics import NormalDist

import numpy as np
import pytest

from tessella.operators import clusters, stationarity, tail_fit, unique_draws

DAY = datetime.date(2020, 1, 1)


def frame(spark, series, extra=()):
    rows = [(k, DAY + datetime.timedelta(i), float(x)) for k, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows + list(extra), "run_id string, dt date, r double").repartition(4)


def fit(y, z):
    b, *_ = np.linalg.lstsq(z, y, rcond=None)
    e = y - z @ b
    return b, float(e @ e)


def plain_adf(x):
    n, most = len(x), min(math.ceil(12 * (len(x) / 100) ** 0.25), len(x) // 2 - 2)
    d = np.diff(x)

    def design(lags, first):
        t = np.arange(first, len(d))
        return d[t], np.column_stack([np.ones(len(t)), x[t], *[d[t - k] for k in range(1, lags + 1)]])

    aic = []
    for lags in range(most + 1):
        y, z = design(lags, most)
        m = len(y)
        aic.append(m * (math.log(2 * math.pi) + math.log(fit(y, z)[1] / m) + 1) + 2 * z.shape[1])
    lags = int(np.argmin(aic))
    y, z = design(lags, lags)
    b, ssr = fit(y, z)
    s2 = ssr / (len(y) - z.shape[1])
    return lags, b[1] / math.sqrt(s2 * np.linalg.inv(z.T @ z)[1, 1])


def plain_kpss(x):
    n, e = len(x), x - x.mean()
    near = int(n ** (2 / 9))
    s0, s1 = e @ e / n, 0.0
    for k in range(1, near + 1):
        p = e[k:] @ e[:-k] / (n / 2)
        s0, s1 = s0 + p, s1 + k * p
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    s = e @ e + sum(2 * (e[k:] @ e[: n - k]) * (1 - k / (lags + 1)) for k in range(1, lags + 1))
    return lags, (np.cumsum(e) ** 2).sum() / n**2 / (s / n)


@pytest.mark.parametrize("block", [64, 8192])
def test_stationarity(spark, monkeypatch, block):
    monkeypatch.setattr(stationarity, "BLOCK", block)
    rng = np.random.default_rng(1)
    ar = np.zeros(260)
    for i in range(1, 260):
        ar[i] = 0.6 * ar[i - 1] + rng.normal()
    series = {"noise": rng.normal(size=200), "walk": rng.normal(size=220).cumsum(), "ar": ar, "short": rng.normal(size=19), "still": np.ones(40), "tiny": rng.normal(size=21)}
    df = frame(spark, series, [("noise", DAY - datetime.timedelta(5), None)])
    adf, kpss = ({r.run_id: r for r in f(df).collect()} for f in (stationarity.dickey_fuller, stationarity.level_stationarity))
    assert set(adf) == set(kpss) == set(series)
    for k in ("noise", "walk", "ar", "tiny"):
        lags, t = plain_adf(series[k])
        assert adf[k].lags == lags and math.isclose(adf[k].statistic, t, rel_tol=1e-6)
        lags, s = plain_kpss(series[k])
        assert kpss[k].lags == lags and math.isclose(kpss[k].statistic, s, rel_tol=1e-9)
        assert math.isclose(kpss[k].p_value, np.interp(s, stationarity.LEVEL_POINTS, stationarity.LEVEL_P))
    assert adf["noise"].stationary and adf["ar"].stationary and not adf["walk"].stationary and kpss["noise"].stationary and not kpss["walk"].stationary
    assert math.isclose(adf["walk"].p_value, NormalDist().cdf(sum(c * adf["walk"].statistic**i for i, c in enumerate(stationarity.TAU_LARGE if adf["walk"].statistic > stationarity.TAU_STAR else stationarity.TAU_SMALL))), rel_tol=1e-6)
    assert all(x[k].statistic is None and not x[k].stationary for x in (adf, kpss) for k in ("short", "still"))
    white = {r.run_id: r for r in stationarity.drifting_variance(df).collect()}
    for k in ("noise", "walk", "ar"):
        x = series[k]
        t = np.arange(len(x))
        y = x * x
        _, ssr = fit(y, np.column_stack([np.ones(len(x)), t, t**2]))
        lm = len(x) * (1 - ssr / ((y - y.mean()) ** 2).sum())
        assert math.isclose(white[k].statistic, lm, rel_tol=1e-6) and math.isclose(white[k].p_value, math.exp(-lm / 2), rel_tol=1e-6)
    assert white["still"].statistic == 0 and white["short"].p_value == 1
    reading = {r.run_id: r.reading for r in stationarity.stationarity_reading(stationarity.dickey_fuller(df), stationarity.level_stationarity(df)).collect()}
    assert reading["noise"] == "stationary" and reading["walk"] == "unit_root" and reading["still"] == "unknown"
    assert stationarity.dickey_fuller(df.limit(0)).count() == stationarity.level_stationarity(df.limit(0)).count() == 0


def test_pareto_tail_meets_its_score_equations(spark):
    rng = np.random.default_rng(2)
    series = {"heavy": rng.standard_t(2.5, 4000) / 100, "normal": rng.normal(size=3000), "bounded": rng.uniform(-1, 1, 2500), "few": rng.normal(size=60), "short": rng.normal(size=40)}
    got = {r.run_id: r for r in tail_fit.pareto_tail(frame(spark, series)).collect()}
    assert set(got) == {"heavy", "normal", "bounded"}  # 60 returns leave three exceedances
    for k, r in got.items():
        x = series[k]
        threshold = np.percentile(x, 5)
        y = threshold - x[x < threshold]
        assert r.exceedances == len(y) and math.isclose(r.threshold, threshold)
        if k != "bounded":  # a regular maximum
            t = r.xi / r.sigma
            assert abs(np.log1p(t * y).mean() - r.xi) < 1e-6
            assert abs((1 + r.xi) * (1 / (1 + t * y)).mean() - 1) < 1e-6
        ratio = 0.01 / (len(y) / len(x))
        loss = r.sigma / r.xi * (ratio**-r.xi - 1)
        assert math.isclose(r.var, threshold - loss) and math.isclose(r.cvar, threshold - (loss + r.sigma) / (1 - r.xi))
    assert 0.2 < got["heavy"].xi < 0.7 and abs(got["normal"].xi) < 0.25 and got["bounded"].xi >= -0.5


def test_sequential_draws(spark):
    weights = {"a": 4.0, "b": 2.0, "c": 1.0}
    rows = [("f", k, w) for k, w in weights.items()] + [("f", "never", 0.0), ("f", "null", None), ("even", "x", 0.0), ("even", "y", None)]
    df = spark.createDataFrame(rows, "family string, item string, w double")
    n = 4000
    drawn = lambda d, **how: {(r.family, r.draw, r.place): r.item for r in unique_draws.sequential_bootstrap(d, "family", "item", "w", n, **how).collect()}
    got = drawn(df, size=4)
    assert got == drawn(df.repartition(7), size=4, per_item=1) == drawn(df.repartition(7), size=4, per_item=2)
    seen = Counter("".join(got["f", d, p] for p in range(1, 4)) for d in range(n))

    def chance(path):
        out, left = 1.0, dict.fromkeys(weights, 0)
        for x in path:
            rate = {k: w / (1 + left[k]) for k, w in weights.items()}
            out *= rate[x] / sum(rate.values())
            left[x] += 1
        return out

    for path in (x + y + z for x in "abc" for y in "abc" for z in "abc"):
        p = chance(path)
        assert abs(seen[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n)
    assert Counter(got["even", d, 1] for d in range(n)).most_common()[1][1] > 0.45 * n
    assert unique_draws.sequential_bootstrap(df.limit(0), "family", "item", "w").count() == 0
    assert unique_draws.sequential_bootstrap(df, "family", "item", "w").where("family = 'f'").count() == 5


def plain_clusters(x, score, names, k, rounds, starts):
    best = None
    for s in range(starts):
        order = sorted(range(len(x)), key=lambda i: (int(hashlib.md5(f"{s}:{names[i]}".encode()).hexdigest()[:8], 16), names[i]))
        centre = x[order[:k]].copy()
        for _ in range(rounds + 1):
            far = ((x[:, None] - centre[None]) ** 2).sum(2)
            label, inertia = far.argmin(1), far.min(1).sum()
            last = centre.copy()
            for c in range(k):
                if (label == c).any():
                    centre[c] = x[label == c].mean(0)
        if best is None or round(inertia, 12) < round(best[0], 12):
            best = inertia, label, last
    return best


def test_clusters(spark):
    rng = np.random.default_rng(3)
    n = 90
    where = np.array([[10, 1.0], [50, 3.0], [90, 2.0]])[rng.integers(0, 3, n)] + rng.normal(0, [3, 0.1], (n, 2))
    score = rng.normal(size=n)
    rows = [("f", i, float(a), float(b), 7.0, float(s)) for i, ((a, b), s) in enumerate(zip(where, score))] + [("one", 1, 1.0, 1.0, 7.0, 0.5), ("same", 1, 2.0, 2.0, 7.0, 0.5), ("same", 2, 2.0, 2.0, 7.0, None)]
    df = spark.createDataFrame(rows, "family string, config int, a double, b double, fixed double, score double").repartition(4)
    got = clusters.parameter_clusters(df, "family", "config", ["a", "b", "fixed"], "score", top=0.5, clusters=3, rounds=6, starts=4).collect()
    top = np.argsort(-score, kind="stable")[: n // 2]
    x = where[top]
    lo, span = x.min(0), x.max(0) - x.min(0)
    inertia, label, centre = plain_clusters(np.c_[(x - lo) / span, np.zeros(len(x))], score[top], [str(i) for i in top], 3, 6, 4)
    mine = {r.cluster: r for r in got if r.family == "f"}
    assert {c: r.size for c, r in mine.items()} == dict(Counter(label.tolist())) and all(math.isclose(r.inertia, inertia, rel_tol=1e-9) for r in mine.values())
    for c, r in mine.items():
        assert np.allclose([r.a, r.b, r.fixed], [*(centre[c][:2] * span + lo), 7.0]) and math.isclose(r.mean_score, score[top][label == c].mean())
    assert {r.family for r in got} == {"f", "same"}
    assert clusters.parameter_clusters(df.limit(0), "family", "config", ["a"], "score").count() == 0
