"""Registered queries against their SQL, and properties of the metrics."""

import datetime
import math

import duckdb
import numpy as np
import pytest

from tessella.functions import stats
from tessella.operators import signals, simulate
from tessella.plans import registry

from .conftest import DATA

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def tidy(df, columns):
    def one(x):
        if isinstance(x, (datetime.datetime, datetime.date)):
            return str(x)[:19].removesuffix(" 00:00:00")
        return None if x is None or x != x else x

    return sorted((tuple(one(x) for x in r) for r in df[columns].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, con, name):
    got, want = registry.QUERIES[name](spark, DATA).toPandas(), con.sql(registry.ORACLE[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and tidy(got, columns) == tidy(want, columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, DATA).count() > 0


def test_simulate_by_hand(spark):
    rows = [("r", "A", d, p, w) for d, p, w in ((1, 100.0, 1.0), (2, 110.0, None), (3, 121.0, 0.0))]
    got = simulate.simulate_weights(spark.createDataFrame(rows, "run_id string, symbol string, dt int, price double, w double")).orderBy("dt").collect()
    assert [round(r.r, 6) for r in got] == [0.1, 0.099] and math.isclose(got[1].cost, 0.001)


def test_distributions():
    assert np.allclose(stats.phi(np.array([0, 1.959963984540054])), [0.5, 0.975]) and np.allclose(stats.phi_inv(np.array([0.5, 0.975])), [0, 1.959963984540054])
    assert math.isclose(stats.chi2_sf(3.841458820694124, 1), 0.05, rel_tol=1e-9) and math.isclose(stats.student_t_sf(2.228138851964939, 10), 0.025, rel_tol=1e-8)


def test_ewm(spark):
    df = spark.createDataFrame([("a", i, float(i % 3)) for i in range(10)], "run_id string, dt int, r double")
    got = [r.ewm for r in signals.ewm(df, "run_id", "r", 0.5).orderBy("dt").collect()]
    m = 0.0
    for i, g in enumerate(got):
        m = 0.5 * (i % 3) + 0.5 * m if i else 0.0
        assert math.isclose(g, m)
