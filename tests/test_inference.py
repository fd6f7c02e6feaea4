"""Distribution functions, regressions, rules and grids against plain NumPy and pandas forms."""

import datetime
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from tessella.functions import stats
from tessella.operators import allocation, grid, panel, regression, search, strategies

DAY = datetime.date(2020, 1, 1)


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(float(x),) for x in values], "x double").select(f("x")).collect()]


def test_normal_and_chi_square(spark):
    xs = [-40.0, -9.0, -7.2, -3.0, -0.5, 0.0, 0.7, 2.0, 7.05, 9.0]
    assert np.allclose(column(spark, xs, stats.norm_cdf), [0.5 * math.erfc(-x / math.sqrt(2)) for x in xs], rtol=1e-9, atol=1e-15)
    ps = [1e-300, 1e-12, 1e-4, 0.07, 0.075, 0.3, 0.5, 0.9, 0.93, 0.999]
    assert np.allclose(column(spark, ps, stats.norm_ppf), [NormalDist().inv_cdf(p) for p in ps], rtol=1e-12)
    assert column(spark, [0, 1], stats.norm_ppf) == [-math.inf, math.inf]
    for k in (1, 2, 5, 10):
        assert np.allclose(column(spark, [0, 0.3, 4, 20, 80], lambda x: stats.chi2_sf_of(x, k)), [stats.chi2_sf(x, k) for x in (0, 0.3, 4, 20, 80)], atol=1e-13)  # noqa: B023


def test_newey_west_errors(spark):
    rng = np.random.default_rng(2)
    n, lags = 120, 4
    x = rng.normal(size=(n, 2))
    y = 0.3 + x @ [1.0, -2.0] + np.convolve(rng.normal(size=n + 3), np.ones(4), "valid")
    rows = [("k", DAY + datetime.timedelta(i), float(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(n)] + [("k", DAY, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, dt date, y double, a double, b double")
    z = np.column_stack([np.ones(n), x])
    inverse = np.linalg.inv(z.T @ z)
    b = inverse @ z.T @ y
    u = z * (y - z @ b)[:, None]
    meat = u.T @ u
    for g in range(1, lags + 1):
        c = u[g:].T @ u[:-g]
        meat += (1 - g / (lags + 1)) * (c + c.T)
    for errors, want in ((lags, inverse @ meat @ inverse), (None, inverse * ((y - z @ b) ** 2).sum() / (n - 3))):
        got = {r.term: r for r in regression.terms(regression.ols(df, "k", "y", ["a", "b"], errors), "k").collect()}
        assert np.allclose([got[t].coef for t in ("const", "a", "b")], b) and np.allclose([got[t].se for t in ("const", "a", "b")], np.sqrt(np.diag(want)))
    r = rng.normal(size=200)
    df = spark.createDataFrame([("k", DAY + datetime.timedelta(i), float(v)) for i, v in enumerate(r)], "run_id string, dt date, r double")
    sq = (r - r.mean()) ** 2
    z = np.column_stack([np.ones(195), *[sq[5 - g : 200 - g] for g in range(1, 6)]])
    e = sq[5:] - z @ np.linalg.lstsq(z, sq[5:], rcond=None)[0]
    assert math.isclose(regression.arch_test(df).head().lm, 195 * (1 - (e @ e) / ((sq[5:] - sq[5:].mean()) ** 2).sum()), rel_tol=1e-6)


def walk(seed, n=900):
    rng = np.random.default_rng(seed)
    return 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n) + 0.004 * np.sin(np.arange(n) / 40)))


@pytest.mark.parametrize("short", [False, True])
def test_dual_ema_by_bars(spark, short):
    x = pd.Series(walk(1))
    df = spark.createDataFrame([("s", DAY + datetime.timedelta(i), float(v)) for i, v in enumerate(x)], "symbol string, dt date, price double")
    lead = np.where(x.ewm(span=20, adjust=False).mean() > x.ewm(span=50, adjust=False).mean(), 1, -1)
    mean = x.rolling(100).mean()
    macro = np.where(mean.isna(), 0, np.where(x > mean, 1, -1))
    want, now = [0.0], 0
    for i in range(1, len(x)):
        crossed = lead[i] != lead[i - 1]
        if now and ((crossed and lead[i] == -now) or macro[i] == -now):
            now = 0
        if now == 0 and macro[i] == lead[i] and macro[i] and (crossed or macro[i - 1] == -macro[i]) and (short or macro[i] == 1):
            now = macro[i]
        want.append(float(now))
    got = [r.w for r in strategies.dual_ema(df, short=short).orderBy("dt").collect()]
    assert got == want and len(set(want)) == (3 if short else 2)


def test_squeeze_breakout_by_bars(spark):
    x = pd.Series(np.r_[walk(2), walk(3)])
    df = spark.createDataFrame([("s", DAY + datetime.timedelta(i), float(v)) for i, v in enumerate(x)], "symbol string, dt date, price double")
    mid, half = x.rolling(20).mean(), 2 * x.rolling(20).std()
    width = 2 * half / mid
    tight = width <= width.rolling(126).min() * 1.05
    want, now, ready = [], 0, False
    for i in range(len(x)):
        ready = ready or (i > 0 and bool(tight[i - 1]))
        if now == 0:
            if ready and abs(x[i] - mid[i]) > half[i]:
                now, ready = (1 if x[i] > mid[i] else -1), False
        elif (x[i] - mid[i]) * now < 0:
            now = 0
        want.append(float(now))
    assert [r.w for r in strategies.squeeze_breakout(df).orderBy("dt").collect()] == want and len(set(want)) == 3


def test_max_sharpe_beats_other_portfolios():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a = rng.normal(size=(40, 6))
        cov, mean = np.cov(a.T), rng.normal(0.1, 0.5, 6)
        w = allocation.max_sharpe(cov, mean)
        ratio = lambda w: (w @ mean) / math.sqrt(w @ cov @ w)  # noqa: B023, E731
        assert math.isclose(w.sum(), 1) and w.min() >= 0
        if mean.max() > 0:
            assert all(ratio(w) >= ratio(x) - 1e-9 for x in rng.dirichlet(np.full(6, 0.4), 300))
    assert np.allclose(allocation.max_sharpe(np.eye(3), np.array([-1.0, -2, -3])), 1 / 3)


def test_grids(spark):
    assert grid.counts([9, 4, 1], 12) == [4, 3, 1] and grid.counts([9, 4, 1], 36) == [9, 4, 1] and grid.counts([5, 5, 2], 20) == [3, 3, 2] and grid.counts([3], 0) == [1]
    for sizes in ([9, 4, 1], [5, 5, 2], [7], [2, 2, 2, 2], [30, 3]):
        for most in range(1, 40):
            c = grid.counts(sizes, most)
            assert math.prod(c) <= max(most, 1) and all(1 <= x <= s for x, s in zip(c, sizes))
    g = {"a": list(range(9)), "b": [1, 2, 3, 4], "c": ["x"]}
    every = grid.lattice(spark, g)
    assert [(r.a, r.b, r.c) for r in every.orderBy("combo").collect()] == [(a, b, "x") for a in range(9) for b in (1, 2, 3, 4)]
    assert sorted((r.a, r.b) for r in grid.lattice(spark, g, 12).collect()) == [(a, b) for a in (0, 2, 5, 8) for b in (1, 2, 4)]
    assert grid.lattice(spark, {"a": [], "b": [1]}).count() == 0
    best = spark.createDataFrame([("p", 0, 3, "x"), ("q", 5, 1, "x"), ("gone", 5, 99, "x")], "k string, a int, b int, c string")
    near = sorted((r.k, r.a, r.b) for r in grid.neighbours(every, best, ["k"]).collect())
    assert near == [("p", a, b) for a in (0, 1) for b in (2, 3, 4)] + [("q", a, b) for a in (4, 5, 6) for b in (1, 2)]
    for n in (1, 5, 16, 35, 36, 99):
        some = [r.combo for r in grid.sampled(every, n).collect()]
        assert len(some) == len(set(some)) == min(n, 36)
    assert len({c // 9 for c in (r.combo for r in grid.sampled(every, 4).collect())}) == 4  # one in every quarter
    rows = spark.createDataFrame([(0, "k", 1, 0.5), (1, "k", 1, 0.7), (2, "k", 1, 0.7), (3, "k", 2, None), (4, "k", 2, None)], "combo int, k string, a int, s double")
    assert sorted(r.combo for r in grid.distinct_settings(rows, ["k"], ["a"], "s").collect()) == [1, 3]


def test_events_and_prices(spark):
    log = [("m", DAY + datetime.timedelta(i), a) for i, a in enumerate(["removed", "added", "added", "removed", "removed", "other", "added"])]
    got = panel.membership_intervals(spark.createDataFrame(log, "member string, dt date, action string")).orderBy("start_dt").collect()
    assert [((r.start_dt - DAY).days, r.end_dt and (r.end_dt - DAY).days) for r in got] == [(1, 3), (6, None)]
    splits = spark.createDataFrame([("s", DAY, x) for x in ("2/1", "1/4", "x", "1/0", None, "3", "0/2")], "symbol string, dt date, split string")
    assert sorted(r.ratio for r in panel.parse_splits(splits).collect()) == [0.25, 2.0]
    bars = panel.positive_prices(spark.createDataFrame([(1.0, 0.0, -1.0)], "open double, high double, close double")).head()
    assert tuple(bars) == (1.0, None, None)
    prices = spark.createDataFrame([("s", DAY + datetime.timedelta(i), c) for i, c in enumerate((100.0, 50.0, 51.0, 50.0))], "symbol string, dt date, close double")
    dividends = spark.createDataFrame([("s", DAY + datetime.timedelta(3), 5.1)], "symbol string, dt date, dividend double")
    ratio = spark.createDataFrame([("s", DAY + datetime.timedelta(1), 2.0)], "symbol string, dt date, ratio double")
    assert np.allclose([r.adj_close for r in panel.adjust_prices(prices, dividends, ratio).orderBy("dt").collect()], [45, 45, 45.9, 50])


def test_robust_choice(spark):
    rng = np.random.default_rng(3)
    rows = [(c, "k", DAY + datetime.timedelta(i), float(v)) for c, mu in ((1, -0.01), (2, 0.002), (3, 0.001)) for i, v in enumerate(mu + 0.01 * rng.normal(size=400))]
    rows += [(1, "bad", DAY + datetime.timedelta(i), float(v)) for i, v in enumerate(-0.01 + 0.001 * rng.normal(size=100))]
    got = {r.k: r for r in search.robust_choice(spark.createDataFrame(rows, "c int, k string, dt date, r double"), "c", "k").collect()}
    assert (got["k"].c, got["k"].priority, got["bad"].c, got["bad"].priority, got["bad"].candidates) == (2, "ROBUST_PERF", None, "REJECTED", 0)
