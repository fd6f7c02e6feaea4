"""Grades by hand: gaps, caps, ties and rows without anything."""

import math

from pyspark.sql import functions as F

from tessella.functions import text
from tessella.operators import panel, scores


def test_badge(spark):
    rows = [(1, 0.2, 1.0, 0.8, True, -0.1), (2, 0.2, 1.0, 0.8, True, -0.7), (3, 0.2, 0.4, 0.8, True, -0.1), (4, 0.2, 1.0, 0.3, True, -0.1), (5, None, None, None, None, None), (6, 0.2, float("nan"), 0.8, False, -0.1)]
    d = spark.createDataFrame(rows, "id int, pbo double, full_sharpe double, consistency double, holdout_ok boolean, max_drawdown double")
    assert [r.badge for r in scores.badge(d).orderBy("id").collect()] == ["ROBUST", "MODERATE", "MODERATE", "FRAGILE", "WEAK", "MODERATE"]
    assert [r.badge for r in scores.badge(d.select("id")).collect()] == ["WEAK"] * 6
    assert scores.badge(d.limit(0)).count() == 0


def test_survival_and_crowding(spark):
    d = spark.createDataFrame([(1, 0.0, 1.0, "MATURITY"), (2, 1.0, 0.0, None), (3, None, None, None)], "id int, pbo double, psr double, phase string")
    got = scores.survival(d).orderBy("id").collect()
    assert math.isclose(got[0].probability, 0.7 ** (1 / 3)) and got[0].weakest_link == "lifecycle" and got[0].verdict == "LIKELY_DURABLE"
    assert math.isclose(got[1].probability, 0.05) and got[1].weakest_link == "not_overfit" and got[1].verdict == "AT_RISK"
    assert got[2].probability is None and got[2].verdict == "INSUFFICIENT_DATA" and got[2].weakest_link is None
    assert math.isclose(scores.crowding(d).orderBy("id").head().score, 100 * (0.3 * 0.5 + 0.25 * 0.5))


def test_composite_and_floors(spark):
    d = spark.createDataFrame([(1, None, float("inf"), True), (2, 0.1, 1.0, True), (3, 0.1, 1.0, False)], "id int, sharpe double, pbo double, hedge boolean")
    assert [r.reasons for r in scores.floors(d, {"sharpe": 0.5}, {"pbo": 0.4}, "hedge").orderBy("id").collect()] == [[], ["pbo"], ["sharpe", "pbo"]]
    middle = math.exp((7 * math.log(5.1) + 3.7 * math.log(0.1) + math.log(0.1 + 10 / 3)) / 11.7)
    assert all(math.isclose(r.composite, middle) for r in scores.composite(d.select("id")).collect())


def test_text_and_counts(spark):
    d = spark.createDataFrame([("a", 0.1234), ("a", float("nan")), ("a", None), ("b", float("-inf"))], "k string, x double")
    got = d.select(text.percent("x").alias("p"), text.number("x", 1).alias("n"), text.bounded("x", 0.0, 0.1).alias("b")).collect()
    assert [tuple(r) for r in got] == [("12.34%", "0.1", 0.1), ("—", "—", 0.0), ("—", "—", 0.0), ("—", "—", 0.0)]
    counts = panel.value_counts(d.withColumn("side", F.when(F.col("x").isNotNull(), "s")), ["k"], "side").orderBy("k").collect()
    assert [(r.k, r.n, r.share) for r in counts] == [("a", 2, 1.0), ("b", 1, 1.0)]
