"""Session trades against plain loops over bars."""

import datetime

import numpy as np

from tessella.operators import session_trades as st

from .test_structure import walked

START = datetime.datetime(2024, 1, 1, 9)


def made(seed, days=40, n=12):
    rng = np.random.default_rng(seed)
    out, price = [], 100.0
    for d in range(days):
        for i in range(n if d % 7 else 4):
            o = price
            c = o + rng.normal(0, 1.5)
            h, low = max(o, c) + rng.exponential(0.5), min(o, c) - rng.exponential(0.5)
            out.append(("a", (START + datetime.timedelta(d)).date(), START + datetime.timedelta(days=d, minutes=15 * i), float(o), float(h), float(low), float(c), float(rng.integers(1, 9))))
            price = c + rng.normal(0, 0.3)
    return out


def plain(rows):
    """Per session: its bars, and the range, high and low known before it."""
    days = sorted({r[1] for r in rows})
    mean, prev, seen, out = None, None, 0, []
    for d in days:
        bars = [r for r in rows if r[1] == d]
        out.append((d, bars, mean if seen >= 14 else None, prev))
        h, low, c = max(b[4] for b in bars), min(b[5] for b in bars), bars[-1][6]
        tr = h - low if prev is None else max(h - low, abs(h - prev[2]), abs(low - prev[2]))
        mean = tr if mean is None else mean * 13 / 14 + tr / 14
        prev, seen = (h, low, c), seen + 1
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "symbol string, session date, bar timestamp, open double, high double, low double, close double, volume double").repartition(4)


def test_opening_fade(spark):
    rows = made(3)
    df = frame(spark, rows)
    for how in ({}, {"most": 1.0, "cap": 0.3, "least": 0.2}, {"from_bar": 5, "least": 0.2}):
        got = {r.session: r for r in st.opening_fade(df, minutes=30, reward=1.5, **how).collect()}
        trades = 0
        for d, bars, atr, _ in plain(rows):
            r, n, want = got[d], len(bars), ("no_entry", 0.0, 0.0)
            last = max(sum((b[2] - bars[0][2]).total_seconds() <= 1800 for b in bars), how.get("from_bar", 0) + 1)
            if atr and n >= 5 and last < n:
                move = bars[last - 1][6] - bars[0][3]
                if how.get("least", 0.4) * atr <= abs(move) <= how.get("most", np.inf) * atr:
                    side, entry, far = -1 if move > 0 else 1, bars[last - 1][6], min(abs(move), how.get("cap", np.inf) * atr)
                    want = walked(entry, side, entry - far * side, entry + far * 1.5 * side, [(b[4], b[5], b[6]) for b in bars[last:]])
                    trades += 1
            assert r.outcome == want[0] and np.allclose([r.pnl, r.worst], want[1:]) and r.entries == (want[0] != "no_entry")
        assert trades > 5
    assert st.opening_fade(df.limit(0)).count() == 0


def test_tired_trend_and_regime(spark):
    rows = made(8)
    df = frame(spark, rows)
    adx = {r.bar: r.adx for r in st.directional_index(df).collect()}
    got, regime = ({r.session: r for r in x.collect()} for x in (st.tired_trend(df, back=2, strong=10.0, stretch=0.3), st.session_regime(df, 1.0, 6)))
    trades = 0
    for d, bars, atr, prev in plain(rows):
        volume = np.cumsum([b[7] for b in bars])
        vwap = np.cumsum([(b[4] + b[5] + b[6]) / 3 * b[7] for b in bars]) / volume
        off = np.array([b[6] for b in bars]) - vwap
        band = [np.std(off[: i + 1], ddof=1) if i else np.nan for i in range(len(bars))]
        want = ("no_entry", 0.0, 0.0)
        for i in range(2, len(bars)):
            now, was = adx[bars[i][2]], adx[bars[i - 2][2]]
            if not atr or now is None or was is None or not (was >= 10 and now < was and band[i] > 0):
                continue
            side = -1 if bars[i][4] >= prev[0] and off[i] >= 0.3 * band[i] else 1 if bars[i][5] <= prev[1] and off[i] <= -0.3 * band[i] else 0
            if side:
                entry = bars[i][6]
                want = walked(entry, side, entry - 0.5 * atr * side, entry + 0.75 * atr * side, [(b[4], b[5], b[6]) for b in bars[i + 1 :]])
                trades += 1
                break
        assert got[d].outcome == want[0] and np.allclose([got[d].pnl, got[d].worst], want[1:])
        far = [abs(o / s) for o, s in zip(off[:6], band[:6]) if s > 0]
        assert regime[d].regime == (-1 if not far else int(np.mean(far) >= 1))
    assert trades > 3
    told, fade = ({r.session: r for r in x.collect()} for x in (st.routed(df, 1.0, 6, minutes=30, least=0.2), st.opening_fade(df, minutes=30, least=0.2, from_bar=6)))
    assert all((r.entries, r.pnl) == ((fade[d].entries, fade[d].pnl) if regime[d].regime == 0 else (0, 0.0)) for d, r in told.items())
