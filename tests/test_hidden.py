"""Hidden-state regimes against a plain pass in logarithms."""

import datetime

import numpy as np

from tessella.operators import hidden

DAY = datetime.date(2020, 1, 1)


def plain_round(x, pi, a, mean, var):
    """Expectation and maximisation by sums of logarithms, bar by bar."""
    n, k = len(x), len(pi)
    log = -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
    f, b = np.empty((n, k)), np.zeros((n, k))
    f[0] = np.log(pi) + log[0]
    for t in range(1, n):
        f[t] = [np.logaddexp.reduce(f[t - 1] + np.log(a[:, j])) + log[t, j] for j in range(k)]
    for t in range(n - 2, -1, -1):
        b[t] = [np.logaddexp.reduce(np.log(a[i]) + log[t + 1] + b[t + 1]) for i in range(k)]
    ll = np.logaddexp.reduce(f[-1])
    g = np.exp(f + b - ll)
    pairs = sum(np.exp(f[t][:, None] + np.log(a) + log[t + 1] + b[t + 1] - ll) for t in range(n - 1))
    mean = (g * x[:, None]).sum(0) / g.sum(0)
    return (g[0], pairs / pairs.sum(1, keepdims=True), mean, (g * (x[:, None] - mean) ** 2).sum(0) / g.sum(0)), ll


def test_rounds_equal_the_plain_pass_and_likelihood_rises():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(m, s, 60) for m, s in ((0.5, 1), (-1, 2), (0.5, 1), (0, 0.5))])
    ends = np.array([90, 170, 240])
    for k in (2, 3):
        params = hidden.start(x, ends, k)
        plain = [tuple(p[i] for p in params) for i in range(3)]
        for _ in range(4):
            params, ll = hidden.maximise(x, ends, params)
            for i, e in enumerate(ends):
                plain[i], want = plain_round(x[:e], *plain[i])
                assert np.isclose(ll[i], want) and all(np.allclose(p[i], q, atol=1e-8) for p, q in zip(params, plain[i]))
        _, seen = hidden.fit(x, ends, k, 40)
        assert len(seen) > 3 and (np.diff(seen, axis=0) > -1e-7).all()


def test_paths_are_the_likeliest():
    import itertools

    rng = np.random.default_rng(2)
    x = rng.normal(size=7)
    params = tuple(p[:1] for p in hidden.start(np.r_[x, rng.normal(size=30)], np.array([37]), 2))
    got = hidden.paths(x, params)[:, 0]
    pi, a, mean, var = (p[0] for p in params)
    log = -0.5 * (np.log(2 * np.pi * var) + (x[:, None] - mean) ** 2 / var)
    worth = lambda s: np.log(pi[s[0]]) + sum(log[t, s[t]] for t in range(7)) + sum(np.log(a[i, j]) for i, j in zip(s, s[1:]))
    assert tuple(got) == max(itertools.product(range(2), repeat=7), key=worth)


def test_regimes(spark):
    rng = np.random.default_rng(3)
    truth = np.repeat([0, 1, 0, 1, 0], 80)
    x = np.where(truth == 0, rng.normal(-0.5, 3, 400), rng.normal(0.5, 0.5, 400))
    rows = [("a", DAY + datetime.timedelta(i), float(v)) for i, v in enumerate(x)] + [("short", DAY + datetime.timedelta(i), float(i)) for i in range(99)] + [("still", DAY + datetime.timedelta(i), 1.0) for i in range(200)] + [("a", DAY - datetime.timedelta(1), None)]
    df = spark.createDataFrame(rows, "run_id string, dt date, r double").repartition(4)
    got = sorted(hidden.hidden_regimes(df).collect(), key=lambda r: r.dt)
    assert {r.run_id for r in got} == {"a"} and len(got) == 400 and {r.states for r in got} == {2}
    assert np.mean(np.array([r.regime for r in got]) == truth) > 0.95
    walked = sorted((r for r in hidden.walked_regimes(df, history=200, refit=20).collect()), key=lambda r: (r.run_id, r.dt))
    mine = [r for r in walked if r.run_id == "a"]
    assert [r.regime for r in mine[:200]] == [-1] * 200 and {r.refits for r in mine} == {10}
    assert np.mean(np.array([r.regime for r in mine[200:]]) == truth[200:]) > 0.8
    # what comes later changes nothing before
    early = {r.dt: r.regime for r in hidden.walked_regimes(df.where(f"dt < '{DAY + datetime.timedelta(300)}'"), history=200, refit=20).collect() if r.run_id == "a"}
    assert all(early[r.dt] == r.regime for r in mine[:300])
    assert {r.regime for r in walked if r.run_id == "short"} == {-1}
    assert hidden.hidden_regimes(df.limit(0)).count() == 0
