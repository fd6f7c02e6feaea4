"""Breaks, rolling ranks, intrabar exits, surrogates, noise and block resamples against plain NumPy forms."""

import datetime
import hashlib
import itertools
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest

from tessella.operators import blocks, inference, intrabar, resample, rolling_rank, search, structure, surrogates

DAY = datetime.date(2020, 1, 1)


def frame(spark, series, extra=()):
    rows = [(k, DAY + datetime.timedelta(i), None if x is None else float(x)) for k, xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows + list(extra), "run_id string, dt date, r double").repartition(4)


def bounds(rows, key):
    return [(r.start_dt, r.end_dt, r.n) for r in sorted((r for r in rows if r.run_id == key), key=lambda r: r.segment)]


def cut(values, at):
    """Dates and lengths of the segments that begin at `at`."""
    edges = [0, *sorted(at), len(values)]
    return [(DAY + datetime.timedelta(a), DAY + datetime.timedelta(b - 1), b - a) for a, b in zip(edges, edges[1:])]


def plain_variance(x):
    sq, segments, found = np.square(x), [(0, len(x))], []
    if len(x) < 50 or not sq.sum():
        return []
    for _ in range(5):
        again = []
        for a, b in segments:
            c = np.cumsum(sq[a:b])
            if b - a >= 10 and c[-1] > 0:
                d = np.abs(c / c[-1] - np.arange(1, b - a + 1) / (b - a))
                p = a + int(d.argmax())
                if math.sqrt((b - a) / 2) * d.max() > structure.SQUARES and a + 5 < p < b - 5:
                    found.append(p)
                    again += [(a, p), (p, b)]
                    continue
            again.append((a, b))
        segments = again
    return found


def plain_mean(x, least, rounds=5):
    n, placed = len(x), []
    ssr = lambda cuts: sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), n]))
    if n < 2 * least:
        return None
    bic = [n * math.log(max(ssr([]) / n, 1e-12)) + 2 * math.log(n)]
    for k in range(1, rounds + 1):
        free = [p for p in range(least, n - least) if all(abs(p - e) >= least for e in [0, n, *placed])]
        if not free:
            break
        placed.append(min(free, key=lambda p: ssr([*placed, p])))
        bic.append(n * math.log(max(ssr(placed) / n, 1e-12)) + (2 * k + 1) * math.log(n))
    return placed[: int(np.argmin(bic))]


def test_breaks(spark):
    rng = np.random.default_rng(5)
    series = {
        "calm": rng.normal(0, 1, 300), "two": np.r_[rng.normal(0, 1, 120), rng.normal(0, 4, 90), rng.normal(0, 1, 110)], "steps": np.r_[rng.normal(0, 1, 80), rng.normal(3, 1, 70), rng.normal(-2, 1, 90), rng.normal(0, 1, 60)],
        "short": rng.normal(0, 1, 30), "still": np.zeros(200), "many": np.concatenate([rng.normal(0, s, 40) for s in (1, 6, 1, 9, 1, 5, 1)]),
    }
    df = frame(spark, series, [("calm", DAY - datetime.timedelta(3), None)])
    got = structure.variance_breaks(df).collect()
    assert len(plain_variance(series["many"])) >= 4
    for k, x in series.items():
        assert bounds(got, k) == cut(x, plain_variance(x))
    means = structure.mean_breaks(df, least=20).collect()
    assert len(plain_mean(series["steps"], 20)) == 3
    for k, x in series.items():
        want = plain_mean(x, 20)
        mine = [r for r in means if r.run_id == k]
        assert bounds(means, k) == cut(x, want or []) and {r.verdict for r in mine} == {"INSUFFICIENT_DATA" if want is None else "STABLE" if not want else "SHIFTING" if len(want) <= 2 else "FRAGMENTED"}
        assert all(math.isclose(r.mean, x[(r.start_dt - DAY).days : (r.end_dt - DAY).days + 1].mean(), abs_tol=1e-9) for r in mine)
    empty = df.limit(0)
    assert structure.variance_breaks(empty).count() == structure.mean_breaks(empty).count() == 0


@pytest.mark.parametrize("block", [16, 4096])
def test_rolling_ranks(spark, block):
    rng = np.random.default_rng(1)
    n, window = 150, 25
    x, y = rng.integers(0, 9, n).astype(float), rng.normal(size=n)
    x[40:62], y[100:101] = np.nan, np.inf
    x[110:140] = 3.0
    rows = [("k", i, None if np.isnan(a) else float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("short", i, 1.0, 2.0) for i in range(24)]
    df = spark.createDataFrame(rows, "symbol string, dt int, x double, y double").repartition(3)
    got = {r.dt: r.ic for r in rolling_rank.rolling_rank_ic(df, "symbol", "x", "y", window, block).collect()}
    assert sorted(got) == list(range(window - 1, n))
    for i, ic in got.items():
        a, b = pd.Series(x[i - window + 1 : i + 1]), pd.Series(y[i - window + 1 : i + 1])
        good = np.isfinite(a) & np.isfinite(b)
        want = a[good].rank().corr(b[good].rank()) if good.sum() >= 5 else 0.0
        assert math.isclose(ic, 0.0 if np.isnan(want) else want, abs_tol=1e-9)
    assert rolling_rank.rolling_rank_ic(df.limit(0), "symbol", "x", "y", window).count() == 0


def walked(entry, side, stop, target, later):
    worst = 0.0
    for h, low, c in later:
        worst = min(worst, ((low if side == 1 else h) - entry) * side)
        if (low <= stop) if side == 1 else (h >= stop):
            return "stop", (stop - entry) * side, min(worst, (stop - entry) * side)
        if (h >= target) if side == 1 else (low <= target):
            return "target", (target - entry) * side, worst
    return ("end", (later[-1][2] - entry) * side, min(worst, (later[-1][2] - entry) * side)) if later else ("none", 0.0, 0.0)


def test_stop_before_target(spark):
    rng = np.random.default_rng(9)
    bars, entries = [], []
    for s in range(30):
        close = 100 + np.cumsum(rng.normal(0, 1, 20))
        for i, c in enumerate(close):
            h, low = c + rng.exponential(0.5), c - rng.exponential(0.5)
            bars.append(("a", s, i, float(h), float(low), float(c)))
        for i in rng.choice(20, 8, replace=False):
            side = int(rng.choice([-1, 1]))
            entries.append(("a", s, int(i), float(close[i]), side, float(close[i] - side * 2), float(close[i] + side * 3)))
    entries.append(("a", 999, 0, 5.0, 1, 4.0, 6.0))  # a session without bars
    e = spark.createDataFrame(entries, "symbol string, session int, bar int, entry double, side int, stop double, target double")
    b = spark.createDataFrame(bars, "symbol string, session int, bar int, high double, low double, close double").repartition(4)
    got = {(r.session, r.bar): (r.outcome, r.pnl, r.worst) for r in intrabar.first_touch(e, b).collect()}
    assert len(got) == len(entries) and {o for o, _, _ in got.values()} == {"stop", "target", "end", "none"}
    for _, s, i, entry, side, stop, target in entries:
        want = walked(entry, side, stop, target, [x[3:] for x in bars if x[1] == s and x[2] > i])
        assert got[s, i][0] == want[0] and np.allclose(got[s, i][1:], want[1:])


def digest(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def uniform(*parts):
    return (digest(*parts) + 0.5) / 2**32


def phases(x, draw):
    s = np.abs(np.fft.rfft(x))
    f = np.array([2 * np.pi * uniform("phase", draw, k) for k in range(len(s))])
    f[0] = 0
    if len(x) % 2 == 0:
        f[-1] = 0
    return np.fft.irfft(s * np.exp(1j * f), n=len(x))


def test_surrogates_keep_the_spectrum(spark):
    rng = np.random.default_rng(3)
    series = {"odd": rng.normal(0.1, 1, 61).cumsum(), "even": rng.normal(0.1, 1, 40)}
    got = surrogates.surrogates(frame(spark, series), "run_id", 3).toPandas()
    for k, x in series.items():
        for d in range(3):
            y = got[(got.run_id == k) & (got.draw == d)].sort_values("i").r.to_numpy()
            assert np.allclose(y, phases(x, d), atol=1e-9)
            circle = lambda z: [float(np.dot(z - z.mean(), np.roll(z - z.mean(), j))) for j in range(len(z))]
            assert np.allclose(circle(y), circle(x), atol=1e-9 * len(x) * x.var()) and not np.allclose(y, x)


def test_surrogate_p_value(spark):
    rng = np.random.default_rng(4)
    price = {"a": 100 * np.exp(np.cumsum(rng.normal(0.001, 0.02, 90))), "b": 50 * np.exp(np.cumsum(rng.normal(0, 0.01, 75))), "few": np.ones(10), "bad": np.r_[np.ones(50), 0.0]}
    rows = [(k, DAY + datetime.timedelta(i), float(x)) for k, xs in price.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, dt date, price double")
    rule = lambda p: search.grid_returns(p, [5]).select("symbol", "dt", "r")
    got = {r.symbol: r for r in surrogates.surrogate_test(df, rule, 12).collect()}
    assert set(got) == {"a", "b"}

    def sharpe(p):
        mean = pd.Series(p).rolling(5).mean()
        w = (pd.Series(p) > mean).astype(float)
        r = (w.shift() * pd.Series(p).pct_change() - 0.001 * w.diff().abs())[1:]
        return r.mean() / r.std() * math.sqrt(252) if r.std() else 0.0

    for k in ("a", "b"):
        p = price[k]
        drawn = [sharpe(p[0] * np.exp(np.cumsum(np.r_[0.0, phases(np.diff(np.log(p)), d)]))) for d in range(12)]
        assert math.isclose(got[k].sharpe, sharpe(p), rel_tol=1e-9) and math.isclose(got[k].surrogate_mean, np.mean(drawn), rel_tol=1e-9)
        assert math.isclose(got[k].p_value, (1 + sum(d >= sharpe(p) for d in drawn)) / 13)


def test_noise(spark):
    rng = np.random.default_rng(7)
    series = {"up": rng.normal(0.02, 0.1, 80), "down": rng.normal(-0.02, 0.1, 50), "few": rng.normal(0, 1, 20)}
    got = surrogates.noise_test(frame(spark, series), [0.5, 2.0], 30).toPandas()
    assert set(got.run_id) == {"up", "down"}
    for k in ("up", "down"):
        x = series[k]
        s = lambda v: v.mean() / v.std(ddof=1) * math.sqrt(252)
        level = {}
        for m in (0.5, 2.0):
            level[m] = np.mean([s(x + m * x.std(ddof=1) * np.array([math.sqrt(-2 * math.log(uniform("radius", d, i))) * math.cos(2 * math.pi * uniform("angle", d, i)) for i in range(len(x))])) for d in range(30)])
            assert math.isclose(got[(got.run_id == k) & (got.level == m)].sharpe.iloc[0], level[m], rel_tol=1e-9)
        worn = got[got.run_id == k].fragility
        assert math.isclose(worn.iloc[0], max((s(x) - level[2.0]) / s(x) / 2, 0)) if s(x) > 0 else worn.isna().all()


def drawn_rows(n, draw, block):
    at, b = [], 0
    while len(at) < n:
        length = 1 + math.floor(math.log(uniform("len", draw, b)) / math.log(1 - 1 / block))
        start = digest("at", draw, b) % n
        at += [(start + j) % n for j in range(length)]
        b += 1
    return at[:n]


def test_block_sums(spark):
    rng = np.random.default_rng(2)
    series = {"a": rng.normal(size=130), "b": rng.normal(size=47), "one": [0.5]}
    rows = blocks.numbered(frame(spark, series), ["run_id"])
    sizes = blocks.family_sizes(rows, ["run_id"])
    got = blocks.block_sums(rows, ["run_id"], ["r"], blocks.stationary_blocks(sizes, 20, 6.0)).collect()
    assert len(got) == 60
    for r in got:
        x = np.array(series[r.run_id])
        assert math.isclose(r.r, x[drawn_rows(len(x), r.draw, 6.0)].sum(), abs_tol=1e-9)
    fixed = {(r.run_id, r.draw): r for r in inference.hashed_bootstrap(frame(spark, series, [("a", DAY - datetime.timedelta(1), None)]), 15, 10).collect()}
    for (k, d), r in fixed.items():
        x = np.array(series[k])
        n = len(x)
        taken = x[[(digest(d, b) % n + j) % n for b in range(-(-n // 10)) for j in range(10) if b * 10 + j < n]]
        assert r.n == n and math.isclose(r.mean, taken.mean(), abs_tol=1e-9) and (n < 2 or math.isclose(r.sd, taken.std(ddof=1), rel_tol=1e-7, abs_tol=1e-9))


def test_confidence_set(spark):
    rng = np.random.default_rng(11)
    n, base = 80, rng.normal(size=80)
    loss = {"m1": base + rng.normal(0, 0.3, n), "m2": base + rng.normal(0.05, 0.3, n), "m3": base + rng.normal(0.5, 0.3, n), "m4": base + rng.normal(0.9, 0.3, n), "twin": None}
    loss["twin"] = loss["m4"].copy()
    rows = [("f", k, DAY + datetime.timedelta(i), float(x)) for k, xs in loss.items() for i, x in enumerate(xs)] + [("tiny", k, DAY + datetime.timedelta(i), float(i)) for k in ("x", "y") for i in range(10)] + [("lone", "x", DAY + datetime.timedelta(i), 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "family string, model string, dt date, loss double").repartition(4)
    got = {(r.family, r.model): r for r in resample.confidence_set(df, "family", "model", 0.1, 60, 5.0).collect()}
    assert all(got[k].survives for k in got if k[0] != "f") and len(got) == 8
    names = sorted(loss)
    left, p_of = list(names), {}
    at = [drawn_rows(n, d, 5.0) for d in range(60)]
    while len(left) > 1:
        mean = np.array([loss[k].mean() for k in left])
        boot = np.array([[loss[k][i].mean() for k in left] for i in at])
        d = (boot - mean)[:, :, None] - (boot - mean)[:, None, :]
        v = d.var(axis=0, ddof=1)
        scale = np.where(v > 1e-25, np.sqrt(v / n + 1e-30), np.inf)
        p = np.mean(np.abs(d / scale).max(axis=(1, 2)) >= np.abs((mean[:, None] - mean[None, :]) / scale).max())
        if p >= 0.1:
            break
        worst = left[int(np.argmax(mean))]
        p_of[worst] = p
        left.remove(worst)
    assert 1 < len(left) < 5
    for k in names:
        assert got["f", k].survives == (k in left) and (k in left or math.isclose(got["f", k].p_value, p_of[k]))


def test_best_of_trials(spark):
    rng = np.random.default_rng(6)
    n, trials = 70, {k: rng.normal(0.02 * k, 0.2, 70) for k in range(5)}
    rows = [("f", k, DAY + datetime.timedelta(i), float(x)) for k, xs in trials.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "family string, trial int, dt date, r double").repartition(3)
    (got,) = resample.romano_wolf(df, "family", "trial", 40, 4.0).collect()
    s = lambda v: v.mean() / v.std(ddof=1)
    top = np.mean([max(s((x - x.mean())[drawn_rows(n, d, 4.0)]) for x in trials.values()) for d in range(40)])
    x = max(trials.values(), key=s)
    z = (x - x.mean()) / x.std()
    se = math.sqrt((1 + 0.5 * s(x) ** 2 - (z**3).mean() * s(x) + ((z**4).mean() - 3) / 4 * s(x) ** 2) / (n - 1))
    assert math.isclose(got.expected_max, top, rel_tol=1e-9) and math.isclose(got.dsr, NormalDist().cdf((s(x) - top) / se), rel_tol=1e-6)
    series = {"a": trials[4], "few": trials[0][:20]}
    got = {r.run_id: r for r in resample.best_of_many(frame(spark, series), 3, draws=25).collect()}
    assert got["few"].verdict == "insufficient_data" and got["few"].p_value == 1
    x = series["a"]
    tops = [max(s(x[[digest(d, a, j) % n for j in range(n)]]) for a in range(3)) for d in range(25)]
    assert math.isclose(got["a"].expected_max, np.mean(tops) * math.sqrt(252), rel_tol=1e-9) and math.isclose(got["a"].p_value, (1 + sum(t >= s(x) for t in tops)) / 26)


def test_purge_longer_than_a_group(spark):
    rng = np.random.default_rng(12)
    n, groups = 60, 10
    r = {c: rng.normal(0.01 * c, 0.1, n) for c in range(4)}
    rows = [("k", c, DAY + datetime.timedelta(i), float(x)) for c, xs in r.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, combo int, dt date, r double").repartition(3)
    for purge, embargo in ((0, 0), (4, 4), (7, 0), (0, 9), (25, 30)):
        s = lambda x: x.mean() / x.std(ddof=1) * math.sqrt(252)
        ranks, won, out, tau = [], [], [], []
        for test in itertools.combinations(range(groups), 2):
            oos = np.zeros(n, bool)
            for g in test:
                oos[g * n // groups : (g + 1) * n // groups] = True
            drop = np.array([oos[max(0, i - max(purge, embargo)) : i + 1].any() or oos[i : i + purge + 1].any() for i in range(n)])
            if (~drop).sum() < 2:
                continue
            a, b = (np.array([s(x[mask]) for x in r.values()]) for mask in (~drop, oos))
            k = int(a.argmax())
            ranks.append(((b <= b[k]).sum() - 0.5) / 4 < 0.5)
            won.append(a[k])
            out.append(b[k])
            signs = [(np.sign(a[i] - a[j]), np.sign(b[i] - b[j])) for i, j in itertools.combinations(range(4), 2)]
            tau.append(sum(x * y for x, y in signs) / math.sqrt(sum(x * x for x, _ in signs) * sum(y * y for _, y in signs)))
        (got,) = search.cpcv_pbo(df, "combo", ["symbol"], purge=purge, embargo=embargo).collect()
        assert got.splits == len(ranks) and np.allclose([got.pbo, got.mean_is, got.mean_oos], [np.mean(ranks), np.mean(won), np.mean(out)])
        (got,) = search.rank_stability(search.cpcv_sharpes(df, "combo", ["symbol"], purge=purge, embargo=embargo), "combo", ["symbol"]).collect()
        assert math.isclose(got.rank_correlation, np.mean(tau), abs_tol=1e-9)


def test_equal_bars_tie_whatever_came_before(spark):
    rng = np.random.default_rng(30)
    n, groups = 100, 10
    common = rng.normal(0.0003, 0.0101, n)
    r = {c: common.copy() for c in range(1, 5)}
    for c in r:
        r[c][: 10 + c] = rng.normal(0, 10.0**-c, 10 + c)  # four pasts, then the same bars; one group is flat
        r[c][40:50] = 0.0
    rows = [("k", c, DAY + datetime.timedelta(i), float(x)) for c, xs in r.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "symbol string, combo int, dt date, r double").repartition(5)
    got = search.cpcv_sharpes(df, "combo", ["symbol"]).toPandas()
    tests = list(itertools.combinations(range(groups), 2))
    for split, d in got.groupby("split"):
        apart = {True: 4, False: 1}
        held = np.isin(np.arange(n) // 10, tests[split])
        assert d.out.nunique() == apart[bool(held[:14].any())] and d.ins.nunique() == apart[bool((~held)[:14].any())]
        s = lambda x: x.mean() / x.std(ddof=1) * math.sqrt(252)
        assert np.allclose(d.sort_values("combo").out, [s(r[c][held]) for c in r], rtol=1e-9)
    assert (search.walk_forward(df.where("dt >= '2020-01-01'"), "combo", ["symbol"], 5, rolling=True, least=5).where("fold > 2").toPandas().combo == 1).all()
    constant = spark.createDataFrame([("k", c, DAY + datetime.timedelta(i), 0.1 + (0.3 * (i < 7))) for c in (1, 2) for i in range(n)], "symbol string, combo int, dt date, r double")
    flat = search.cpcv_sharpes(constant, "combo", ["symbol"]).where("split > 20").toPandas()
    assert len(flat) and (flat.out == 0).all()
    odd = df.union(spark.createDataFrame([("k", c, DAY - datetime.timedelta(1), math.nan) for c in r], df.schema))
    assert search.cpcv_sharpes(odd, "combo", ["symbol"]).toPandas().sort_values(["split", "combo"]).out.tolist() == got.sort_values(["split", "combo"]).out.tolist()


def test_moving_volatility_of_a_long_key(spark):
    from tessella.operators import signals

    rng = np.random.default_rng(13)
    n = 50_000
    price = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    df = spark.createDataFrame(pd.DataFrame({"symbol": "a", "dt": np.arange(n), "price": price}))
    got = signals.ewm_volatility(df).orderBy("dt").toPandas().vol
    want = pd.Series(np.log(price / np.r_[np.nan, price[:-1]])).ewm(span=100).std()
    assert np.allclose(got, want, rtol=1e-9, equal_nan=True)
    labels = signals.triple_barrier(df, 10, 1.5, 1.0).toPandas()
    assert set(labels[labels.dt > 45_000].label) == {-1, 0, 1} and (signals.triple_barrier(df.where("dt < 300"), 10, 0, 1.0).toPandas().label < 1).all()


def test_tests_of_families(spark):
    rng = np.random.default_rng(21)
    n = 90
    trials = {0: rng.normal(0, 0.1, n), 1: rng.normal(0.08, 0.1, n), 2: rng.normal(0.05, 0.1, n), 3: rng.normal(-0.2, 0.1, n), 4: np.zeros(n), 5: rng.normal(0.03, 0.1, n)}
    rows = [("f", k, DAY + datetime.timedelta(i), float(x)) for k, xs in trials.items() for i, x in enumerate(xs)] + [("g", 0, DAY + datetime.timedelta(i), float(x)) for i, x in enumerate(trials[3])]
    df = spark.createDataFrame(rows, "family string, trial int, dt date, r double").repartition(4)
    at = [drawn_rows(n, d, 5.0) for d in range(80)]
    x = np.column_stack([trials[k] for k in range(6)])
    mean, sd = x.mean(0), x.std(0, ddof=1)
    boot = np.stack([x[i].mean(0) for i in at])
    got = {r.family: r for r in resample.reality_check(df, "family", "trial", 80, 5.0).collect()}
    stat = math.sqrt(n) * mean.max()
    assert math.isclose(got["f"].statistic, stat) and math.isclose(got["f"].p_value, (1 + (math.sqrt(n) * (boot - mean).max(1) >= stat - 1e-12).sum()) / 81)
    scale = np.where(sd > 0, sd / math.sqrt(n), np.inf)
    t = mean / scale
    p = lambda c: float(((boot - c) / scale).max(1).__ge__(t.max()).mean())
    near = np.where(t >= -math.sqrt(2 * math.log(math.log(n))), mean, 0)
    left, z = np.ones(6, bool), (boot - mean) / scale
    while left.any():
        new = left & (t > np.percentile(z[:, left].max(1), 95))
        if not new.any():
            break
        left &= ~new
    got = {r.family: r for r in resample.superior_ability(df, "family", "trial", 80, 5.0).collect()}
    r = got["f"]
    assert np.allclose([r.statistic, r.p_lower, r.p_consistent, r.p_upper], [t.max(), p(mean), p(near), p(0.0)]) and r.rejected == (~left).sum() and 2 <= r.rejected < 6
    assert got["g"].rejected == 0 and got["g"].p_lower > 0.5


def test_posterior_sharpe(spark):
    rng = np.random.default_rng(30)
    x = rng.normal(0.001, 0.01, 20_000)
    got = {r.run_id: r for r in search.posterior_sharpe(frame(spark, {"long": x, "few": [0.1, 0.2, 0.3]})).collect()}
    s = x.mean() / x.std(ddof=1) * math.sqrt(252)
    spread = math.sqrt(252 / len(x) * (1 + (s / math.sqrt(252)) ** 2 / 2))  # of a Sharpe of so many returns
    r = got["long"]
    assert abs(r.posterior - s) < 0.1 * spread and abs((r.high - r.low) / (2 * 1.645 * spread) - 1) < 0.05 and r.decision == "DEPLOY"
    assert got["few"].decision == "INSUFFICIENT_DATA"
