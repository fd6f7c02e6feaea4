"""Sobol points, cross-validated book scores and the greedy chain against plain NumPy forms."""

import datetime
import itertools
import math

import numpy as np
import pytest

from tessella.operators import book_search

DAY = datetime.date(2020, 1, 1)


def returns(spark, x, family="f", gaps=()):
    rows = [(family, f"n{j}", DAY + datetime.timedelta(i), float(v)) for i, row in enumerate(x) for j, v in enumerate(row) if (i, j) not in gaps]
    return spark.createDataFrame(rows, "family string, run_id string, dt date, r double").repartition(4)


def test_sobol_fills_every_interval_once(spark):
    dims = len(book_search.SOBOL) + 1
    u = np.array([r.u for r in book_search.sobol(spark, 256, dims).orderBy("point").collect()])
    assert u.shape == (256, dims) and len({tuple(x) for x in u}) == 256
    for n in (16, 64, 256):  # every dyadic interval of a dimension holds one of the first n points
        assert all(sorted(np.floor(u[:n, d] * n).astype(int)) == list(range(n)) for d in range(dims))
    # the plane of the first two dimensions is cut evenly, too
    assert all(len({(int(a * 2**k), int(b * 2 ** (8 - k))) for a, b in u[:, :2]}) == 256 for k in range(9))
    with pytest.raises(ValueError):
        book_search.sobol(spark, 4, dims + 1)
    w = [r.w for r in book_search.simplex(book_search.sobol(spark, 64, 3)).collect()]
    assert len(w) == len({tuple(x) for x in w}) and all(abs(sum(x) - 1) < 2e-4 and min(x) >= 0 for x in w)


def sharpe(x):
    return x.mean() / x.std(ddof=1) * math.sqrt(252) if x.std(ddof=1) > 1e-12 else 0.0


def test_book_scores(spark):
    rng = np.random.default_rng(1)
    n, k = 237, 3
    x = rng.normal(0.001, 0.01, (n, k))
    gaps = {(5, 0), (100, 2)}
    short = rng.normal(0.001, 0.01, (90, k))
    df = returns(spark, x, gaps=gaps).unionByName(returns(spark, short, "short"))
    w = [[1.0, 0.0, 0.0], [0.2, 0.3, 0.5], [1 / 3] * 3, [0.5, 0.5]]
    samples = spark.createDataFrame(list(enumerate(w)), "sample int, w array<double>")
    got = {(r.family, r.sample): r for r in book_search.book_scores(df, samples, "family").collect()}
    assert set(got) == {(f, s) for f in ("f", "short") for s in range(3)}
    full = x[[i for i in range(n) if not any(g[0] == i for g in gaps)]]
    edges = [g * len(full) // 10 for g in range(11)]
    for s in range(3):
        b = full @ w[s]
        oos = [sharpe(np.r_[b[edges[i] : edges[i + 1]], b[edges[j] : edges[j + 1]]]) for i, j in itertools.combinations(range(10), 2)]
        r = got["f", s]
        assert r.n == len(full) and np.allclose([r.sharpe, r.oos_mean, r.oos_std, r.stability], [sharpe(b), np.mean(oos), np.std(oos), np.mean(oos) / (1 + np.std(oos))])
        r = got["short", s]
        assert r.n == 90 and np.allclose([r.sharpe, r.oos_mean, r.oos_std], [sharpe(short @ w[s])] * 2 + [0])
    assert book_search.book_scores(df.limit(0), samples, "family").count() == 0


def test_best_books_and_chain(spark):
    rng = np.random.default_rng(2)
    x = rng.normal([0.001, 0.0005, 0.0, -0.001], [0.01, 0.02, 0.005, 0.01], (400, 4))
    df = returns(spark, x)
    samples = book_search.simplex(book_search.sobol(spark, 64, 4))
    best = book_search.best_books(df, samples, "family", 5).orderBy("place").collect()
    assert [r.place for r in best] == [1, 2, 3, 4, 5] and all(a.composite >= b.composite for a, b in zip(best, best[1:]))
    for r in best:
        b = x @ np.array(r.w)
        e = np.exp(np.cumsum(np.log1p(b)))
        months = {}
        for i, v in enumerate(b):
            d = DAY + datetime.timedelta(i)
            months[d.year, d.month] = months.get((d.year, d.month), 0) + math.log1p(v)
        assert math.isclose(r.positive_months, np.mean([v > 0 for v in months.values()])) and math.isclose(r.cagr, e[-1] ** (252 / 400) - 1, rel_tol=1e-9)
        assert math.isclose(r.max_drawdown, (e / np.maximum.accumulate(e) - 1).min(), rel_tol=1e-9)
        assert math.isclose(r.composite, r.stability * max(r.dsr, 0.3) * r.positive_months * r.positive_years, rel_tol=1e-9)
    left, held, want = list(range(4)), [], []
    while left:
        p = max(left, key=lambda j: (round(sharpe(x[:, [*held, j]].mean(1)), 12), -j))
        held.append(p)
        left.remove(p)
        want.append((len(held), f"n{p}", sharpe(x[:, held].mean(1))))
    chain = sorted((r.place, r.run_id, r.sharpe) for r in book_search.greedy_chain(df, "family", 6).collect())
    assert [c[:2] for c in chain] == [c[:2] for c in want] and np.allclose([c[2] for c in chain], [c[2] for c in want])
