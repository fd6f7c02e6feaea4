"""The optimiser's two passes and its report against its parts and a plain search."""

import datetime
import math

import numpy as np

from tessella.operators import optimise, resample, search, validation

DAY = datetime.date(2020, 1, 1)
LEVELS = {"a": list(range(9)), "b": [1, 2, 3, 4]}
PEAK = {"x": (6, 3), "y": (1, 1)}


def rule(prices, combos):
    """Returns that are better the nearer a combination lies to its symbol's peak, on the same noise."""
    from pyspark.sql import functions as F

    peak = F.create_map(*[F.lit(v) for k, p in PEAK.items() for v in (k, F.array(F.lit(p[0]), F.lit(p[1])))])
    far = F.abs(F.col("a") - peak[F.col("symbol")][0]) + F.abs(F.col("b") - peak[F.col("symbol")][1])
    return prices.crossJoin(combos).select("symbol", "a", "b", "dt", (F.col("price") * (1 + far * 0.3) + 0.004 - 0.001 * far).alias("r"))


def test_two_passes_and_report(spark):
    rng = np.random.default_rng(4)
    noise = {k: rng.normal(0, 0.01, 260) for k in PEAK}
    prices = spark.createDataFrame([(k, DAY + datetime.timedelta(i), float(x)) for k in PEAK for i, x in enumerate(noise[k])], "symbol string, dt date, price double").repartition(4)
    tried = optimise.two_pass(prices, rule, LEVELS, "symbol", most=12, span=1)
    got = {k: sorted((r.a, r.b) for r in tried.where(f"symbol = '{k}'").select("a", "b").distinct().collect()) for k in PEAK}
    assert tried.groupBy("symbol", "combo", "dt").count().where("count > 1").count() == 0

    def sharpe(k, a, b):
        far = abs(a - PEAK[k][0]) + abs(b - PEAK[k][1])
        r = noise[k] * (1 + far * 0.3) + 0.004 - 0.001 * far
        return r.mean() / r.std(ddof=1) * math.sqrt(252)

    coarse = [(a, b) for a in (0, 2, 5, 8) for b in (1, 2, 4)]
    for k in PEAK:
        a, b = max(coarse, key=lambda c: sharpe(k, *c))
        near = {(i, j) for i in range(9) for j in (1, 2, 3, 4) if abs(i - a) <= 1 and abs(j - b) <= 1}
        assert got[k] == sorted(near | set(coarse))
    out = {r.symbol: r for r in optimise.report(tried, "symbol", default=0, purge=3, draws=30, block=5.0).collect()}
    judged = {r.run_id: r for r in validation.validate_search(tried, "combo", "symbol", purge=3).collect()}
    wf = {r.symbol: r for r in search.walk_forward_summary(search.walk_forward(tried, "combo", ["symbol"], 5, 3), "combo", ["symbol"]).collect()}
    for k, r in out.items():
        a, b = max(got[k], key=lambda c: sharpe(k, *c))
        assert r.combo == a * 4 + b - 1 and r.tried == len(got[k]) and math.isclose(r.sharpe, sharpe(k, a, b)) and math.isclose(r.improvement, sharpe(k, a, b) - sharpe(k, 0, 1))
        assert (r.pbo, r.score, r.verdict) == (judged[k].pbo, judged[k].score, judged[k].verdict) and math.isclose(r.wf_oos, wf[k].oos_mean)
    base = tried.where("combo = 0").selectExpr("symbol", "dt", "r AS base")
    able = {r.symbol: r for r in resample.superior_ability(tried.join(base, ["symbol", "dt"]).selectExpr("symbol", "combo", "dt", "r - base AS r"), "symbol", "combo", 30, 5.0).collect()}
    assert all(out[k].able_p == able[k].p_consistent and out[k].rejected == able[k].rejected for k in PEAK)
    few = optimise.report(tried.where("combo < 3"), "symbol", default=99, draws=10).collect()
    assert all(r.reality_p is None and r.default_sharpe is None for r in few) and len(few) == 2
    log = spark.createDataFrame([("r", "2020", 5), ("r", "2021", 7), ("s", "2020", 9)], "rule string, at string, trials int")
    assert optimise.trials_before(log, "r") == 12 and optimise.trials_before(log, "none") == 0
