"""Hand-computed cases of operators, sources and streams."""

import datetime
import zipfile

import numpy as np
import pytest

from tessella.operators import allocation, diagnosis, panel, search, strategies
from tessella.sources import files, registry, synthetic

DAY = datetime.date(2020, 1, 1)


def days(n):
    return [DAY + datetime.timedelta(i) for i in range(n)]


def prices(spark, values, symbol="A"):
    return spark.createDataFrame([(symbol, d, float(x)) for d, x in zip(days(len(values)), values)], "symbol string, dt date, price double")


def test_channel_breakout(spark):
    got = strategies.channel_breakout(prices(spark, [1, 2, 1, 3, 2, 0, 5]), enter=3, leave=2).orderBy("dt").collect()
    assert [r.w for r in got] == [0, 0, 0, 1, 1, 0, 1]


def test_dual_ema_is_flat_until_the_long_mean_is_there(spark):
    got = strategies.dual_ema(prices(spark, list(range(10, 0, -1)) + list(range(1, 40))), 2, 5, 8).orderBy("dt").collect()
    w = [r.w for r in got]
    assert set(w[:12]) == {0.0} and w[-1] == 1.0


def test_rules_take_empty_tables(spark):
    none = prices(spark, [])
    for f in (strategies.ma_crossover, strategies.dual_ema, strategies.squeeze_breakout, strategies.oversold, strategies.momentum_weights):
        assert f(none).count() == 0


def test_uniqueness_by_hand(spark):
    p = prices(spark, [1] * 6)
    got = diagnosis.uniqueness(p.where(f"dt in (date'{days(1)[0]}', date'{days(2)[1]}')"), p, bars=2).orderBy("dt").collect()
    # spans 0..2 and 1..3; concurrency 1, 2, 2, 1
    assert np.allclose([r.weight for r in got], [1, 1])


def test_lookahead_finds_a_leak(spark):
    p = prices(spark, np.linspace(10, 20, 40) + np.sin(np.arange(40)))
    leaky = lambda x: x.withColumn("w", panel.F.lead("price").over(panel.along("symbol")))
    fair = lambda x: x.withColumn("w", panel.F.lag("price").over(panel.along("symbol")))
    assert diagnosis.lookahead(leaky, p).head().leaks and not diagnosis.lookahead(fair, p).head().leaks


def test_weights(spark):
    cov = np.array([[0.04, 0.01, 0.0], [0.01, 0.09, 0.02], [0.0, 0.02, 0.16]])
    w = allocation.min_variance(cov)
    closed = np.linalg.solve(cov, np.ones(3))
    assert np.allclose(w, closed / closed.sum(), atol=1e-6)
    share = allocation.risk_parity(cov)
    share = share * (cov @ share)
    assert np.allclose(share / share.sum(), 1 / 3, atol=1e-6)
    for f in allocation.METHODS.values():
        w = f(cov, np.array([0.1, 0.05, 0.02]))
        assert np.isclose(w.sum(), 1) and (w >= 0).all()
    assert np.allclose(allocation.hierarchical(np.diag([1.0, 1.0, 1.0, 1.0])), 0.25)


def test_walk_forward_purges(spark):
    rows = [(c, d, float((i % 5) * (1 if c == 1 else -1) + i / 100)) for c in (1, 2) for i, d in enumerate(days(150))]
    r = spark.createDataFrame([("k", *x) for x in rows], "k string, fast int, dt date, r double")
    for purge in (0, 3):
        got = search.walk_forward(r, "fast", ["k"], purge=purge).orderBy("fold").collect()
        assert [x.fold for x in got] == [1, 2, 3, 4, 5] and {x.fast for x in got} == {1}
        one = np.array([x[2] for x in rows[:25]])[: 25 - purge]
        assert np.isclose(got[0].is_sharpe, one.mean() / one.std(ddof=1) * np.sqrt(252))
    # a sample of under twenty bars is none; a purge longer than a step reaches into the steps before
    assert [x.fold for x in search.walk_forward(r, "fast", ["k"], purge=6).orderBy("fold").collect()] == [2, 3, 4, 5]
    late = search.walk_forward(r, "fast", ["k"], purge=40).orderBy("fold").collect()
    one = np.array([x[2] for x in rows[:75]])[:35]
    assert [x.fold for x in late] == [3, 4, 5] and np.isclose(late[0].is_sharpe, one.mean() / one.std(ddof=1) * np.sqrt(252))


def test_members_on(spark):
    m = spark.createDataFrame([("a", DAY, None), ("b", DAY, DAY)], "m string, start date, end date")
    d = spark.createDataFrame([(x,) for x in days(2)], "dt date")
    assert sorted((r.dt, r.m) for r in panel.members_on(m, d).collect()) == [(days(2)[0], "a"), (days(2)[0], "b"), (days(2)[1], "a")]


def test_json_lines_skip_bad_ones(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"slug": "a", "metrics": {"s": NaN, "t": 1.5}}\nnot json\n{"slug": "b", "metrics": {"s": 2}}\n')
    got = registry.load(spark, str(tmp_path / "x.jsonl")).orderBy("slug").collect()
    assert [(r.slug, r.metrics) for r in got] == [("a", {"s": None, "t": 1.5}), ("b", {"s": 2.0})]


def test_zipped_csv(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("one.csv", "dt,r\n2020-01-01,1\n2020-01-02,2\n")
        z.writestr("two.csv", "dt,r\n")
    got = files.read_zipped_csv(spark, f"file://{tmp_path}/x.zip", ["dt", "r"]).collect()
    assert sorted((r.file, r.member, r.r) for r in got) == [("x.zip", "one.csv", "1"), ("x.zip", "one.csv", "2")]


def test_returns_folder(spark, tmp_path):
    (tmp_path / "long.csv").write_text("date,returns\n" + "".join(f"{d},0.01\n" for d in days(30)) + "2021-01-01,oops\n")
    (tmp_path / "short.csv").write_text("date,returns\n2020-01-01,0.01\n")
    got = files.read_returns(spark, f"file://{tmp_path}/*.csv")
    assert got.count() == 30 and {r.run_id for r in got.collect()} == {"long"}


@pytest.mark.parametrize("rows, want", [([], {}), ([(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5)], {1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (9, 1), 5: (None, None), 6: (None, None)})])
def test_lineage(spark, rows, want):
    got = registry.lineage(spark.createDataFrame(rows, "id long, parent long"), "id", "parent").collect()
    assert {r.node: (r.root, r.depth) for r in got} == want


def test_synthetic(spark):
    a, b = (synthetic.prices(spark, ["A", "B"], 50).orderBy("symbol", "dt").collect() for _ in range(2))
    assert a == b and len(a) == 100
    spark.dataSource.register(synthetic.SyntheticPrices)
    d = spark.read.format("synthetic_prices").options(symbols="A,B", days=40).load()
    assert d.count() == 80 and d.select("symbol").distinct().count() == 2
