"""Snapshots, filled buckets, regimes by level, conditional predictive ability and Kelly books against plain forms."""

import datetime
import hashlib
import math

import numpy as np

from tessella.operators import allocation, diagnosis, panel, signals
from tessella.sources import snapshots

DAY = datetime.date(2020, 1, 1)


def test_snapshots(spark, tmp_path):
    data = {"a.bin": b"one", "sub/b.bin": b"b", "sub/deep/c.bin": bytes(range(256)) * 50}
    for name, raw in data.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    (tmp_path / "other.txt").write_text("x")
    found = snapshots.manifest(spark, str(tmp_path), "*.bin")
    want = {k: (len(v), hashlib.sha256(v).hexdigest()) for k, v in data.items()}
    assert {r.path: (r.bytes, r.sha256) for r in found.collect()} == want == {r.path: (r.bytes, r.sha256) for r in snapshots.manifest(spark, f"file://{tmp_path}/", "*.bin").collect()}
    (whole,) = snapshots.snapshot_sha256(found).collect()
    assert whole.files == 3 and whole.snapshot_sha256 == hashlib.sha256("\n".join(f"{want[k][1]}  {k}" for k in sorted(want)).encode()).hexdigest()
    recorded = spark.createDataFrame([(k, v[1]) for k, v in want.items()], "path string, sha256 string")
    assert snapshots.differences(recorded, found).count() == 0
    (tmp_path / "a.bin").write_bytes(b"two")
    (tmp_path / "sub/b.bin").unlink()
    (tmp_path / "new.bin").write_bytes(b"n")
    again = snapshots.differences(recorded, snapshots.manifest(spark, str(tmp_path), "*.bin"))
    assert sorted(map(tuple, again.collect())) == [("a.bin", "changed"), ("new.bin", "added"), ("sub/b.bin", "missing")]


def test_manifest_of_large_files(spark, tmp_path):
    rng = np.random.default_rng(8)
    sizes = {"a b%20.bin": 1001, "b.bin": 3 * 4096, "c.bin": 3 * 4096 + 1, "d.bin": 1000, "e.bin": 20_001}
    for name, n in sizes.items():
        (tmp_path / name).write_bytes(rng.bytes(n))
    want = {k: (n, hashlib.sha256((tmp_path / k).read_bytes()).hexdigest()) for k, n in sizes.items()}
    for piece in (4096, 5000, 1 << 20):
        assert {r.path: (r.bytes, r.sha256) for r in snapshots.manifest(spark, str(tmp_path), "*.bin", 1000, piece).collect()} == want
    n = (1 << 31) + 5  # more than a row can hold
    with open(tmp_path / "sparse.big", "wb") as f:
        f.truncate(n)
    digest = hashlib.sha256()
    for at in range(0, n, 1 << 24):
        digest.update(bytes(min(1 << 24, n - at)))
    (got,) = snapshots.manifest(spark, str(tmp_path), "*.big").collect()
    assert (got.path, got.bytes, got.sha256) == ("sparse.big", n, digest.hexdigest())


def test_filled_buckets(spark):
    at = datetime.datetime(2024, 1, 1, 9)
    rows = [("a", at, 1.0, 2.0, 0.5, 1.5, 3.0, 2), ("a", at + datetime.timedelta(hours=3), 4.0, 5.0, 3.0, 4.5, 1.0, 1), ("b", at, 7.0, 7.0, 7.0, 7.0, 1.0, 1)]
    df = spark.createDataFrame(rows, "symbol string, bar timestamp, open double, high double, low double, close double, volume double, trades int")
    got = panel.fill_buckets(df).where("symbol = 'a'").orderBy("bar").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume, r.trades) for r in got] == [rows[0][2:], (1.5,) * 4 + (0.0, 0), (1.5,) * 4 + (0.0, 0), rows[1][2:]]
    assert panel.fill_buckets(df).count() == 5 and panel.fill_buckets(df.limit(0)).count() == 0


def test_level_and_trend(spark):
    df = spark.createDataFrame([(x,) for x in (10.0, 15.0, 20.0, 25.0, 30.0, None)], "v double")
    assert [r.regime for r in signals.level_regime(df, "v", 15.0, 25.0).collect()] == [0, 0, 1, 2, 2, 1]
    p = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate([1, 2, 3, 1, 5])], "symbol string, dt int, price double")
    assert [r.regime for r in signals.trend_regime(p, 3).orderBy("dt").collect()] == [0, 0, 1, 0, 1]


def test_xi_of_few_pairs(spark):
    rows = [("few", i, float(i), float(i)) for i in range(4)] + [("line", i, float(i), float(i * i)) for i in range(40)]
    got = {r.k: r for r in signals.xi_significance(spark.createDataFrame(rows, "k string, dt int, x double, y double"), "k", "x", "y").collect()}
    assert (got["few"].xi, got["few"].p_value, got["few"].n) == (0, 1, 4)
    xi = 1 - 3 * 39 / (40**2 - 1)
    assert math.isclose(got["line"].xi, xi) and got["line"].p_value < 1e-6


def test_giacomini_white(spark):
    rng = np.random.default_rng(1)
    n = 80
    a, b, h = rng.normal(1, 1, n), rng.normal(1.4, 1, n), rng.normal(size=n)
    rows = [("k", float(x), float(y), 1.0, float(z)) for x, y, z in zip(a, b, h)] + [("k", None, 1.0, 1.0, 1.0), ("few", 1.0, 2.0, 1.0, 3.0)]
    got = {r.k: r for r in diagnosis.giacomini_white(spark.createDataFrame(rows, "k string, a double, b double, one double, h double"), "k", "a", "b", ["one", "h"]).collect()}
    z = np.column_stack([a - b, h * (a - b)])
    stat = n * z.mean(0) @ np.linalg.inv(np.cov(z, rowvar=False)) @ z.mean(0)
    assert math.isclose(got["k"].statistic, stat) and math.isclose(got["k"].p_value, math.exp(-stat / 2)) and got["k"].n == n
    assert (got["few"].statistic, got["few"].p_value, got["few"].different) == (0, 1, False)


def test_multi_kelly(spark):
    rng = np.random.default_rng(2)
    x = rng.normal([0.002, 0.001, 0.0], [0.01, 0.02, 0.015], (200, 3))
    rows = [("f", f"n{j}", DAY + datetime.timedelta(i), float(v)) for i, r in enumerate(x) for j, v in enumerate(r)]
    rows += [("same", k, DAY + datetime.timedelta(i), float(v)) for i, v in enumerate(x[:, 0]) for k in ("p", "q")] + [("few", k, DAY + datetime.timedelta(i), float(x[i, j])) for i in range(4) for j, k in enumerate(("p", "q"))]
    got = {(r.family, r.run_id): r for r in allocation.multi_kelly(spark.createDataFrame(rows, "family string, run_id string, dt date, r double").repartition(3), "family").collect()}
    f = np.linalg.solve(np.cov(x, rowvar=False), x.mean(0))
    squared = x.mean(0) @ f
    assert np.allclose([got["f", f"n{j}"].kelly for j in range(3)], f) and np.allclose([got["f", f"n{j}"].shrunk for j in range(3)], f * 200 * squared / (200 * squared + 5))
    assert got["same", "p"].kelly == got["same", "q"].shrunk == 0 and got["few", "p"].kelly != 0 and got["few", "p"].shrunk == 0
