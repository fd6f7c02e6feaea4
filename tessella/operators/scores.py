"""Grades from metrics that are known already: badges, crowding, survival, composite scores, floors for candidates.

Every function adds columns to rows of one strategy or configuration each; a metric whose column is absent, null, NaN or
infinite is unknown. No row needs another one, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.metrics import finite
from tessella.functions.text import bounded

# Labels from worst to best, the factors that many hold, how common a family's recipe is, what a phase promises.
BADGES = ("WEAK", "FRAGILE", "MODERATE", "ROBUST")
CROWDED = ("momentum", "value", "size", "low_vol", "quality")
FAMILIES = {"Momentum": 0.85, "MeanReversion": 0.65, "Trend": 0.70, "Factor": 0.80, "Seasonality": 0.40, "GEM": 0.75, "PairTrading": 0.55}
PHASES = {"EMERGENCE": 0.75, "EXPLOITATION": 0.85, "MATURITY": 0.70, "DECLINE": 0.25, "INSUFFICIENT_DATA": 0.50}
# The range that a metric's pillar spans from 0 to 10.
RANGES = {"psr": (0.5, 0.99), "upi": (0.0, 5.0), "stability": (0.0, 1.0), "rolling_consistency": (0.0, 1.0), "sortino": (-1.0, 5.0)}


def known(d: DataFrame, name: str) -> Column:
    return finite(d[name].cast("double")) if name in d.columns else F.lit(None).cast("double")


def _is(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _looked_up(key: Column, table: dict[str, float]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(0.5))


def badge(d: DataFrame) -> DataFrame:
    """Adds rank (0 to 3) and badge: one step each for a credible edge, for steadiness and for a sound recent past, then caps.

    Reads pbo, full_sharpe, consistency (else wf_eff), holdout_ok (else oos_sharpe) and max_drawdown. An unknown metric
    neither earns a step nor sets a cap.
    """
    x = lambda name: known(d, name)
    sharpe, steady, depth = x("full_sharpe"), x("consistency"), x("max_drawdown")
    held = d["holdout_ok"].cast("boolean") if "holdout_ok" in d.columns else F.lit(None).cast("boolean")
    steps = [
        _is(x("pbo") <= 0.5) & F.coalesce(sharpe >= 0.5, F.lit(True)),
        _is(F.coalesce(steady >= 0.6, x("wf_eff") >= 0.6)),
        _is(F.coalesce(held, x("oos_sharpe") >= 0.7)),
    ]
    caps = [
        F.when(sharpe < 0.3, 1).when(sharpe < 0.5, 2),
        F.when(depth < -0.8, 1).when(depth < -0.6, 2),
        F.when(steady < 0.4, 1),
    ]
    rank = F.least(sum(s.cast("int") for s in steps), *caps)
    return d.withColumn("rank", rank).withColumn("badge", F.element_at(F.array(*map(F.lit, BADGES)), F.col("rank") + 1))


def crowding(d: DataFrame) -> DataFrame:
    """Adds score (0 to 100) and verdict from betas to the factors many hold, `family`, `capacity_usd` and `annual_turnover`."""
    betas = [F.abs(known(d, k)) for k in CROWDED if k in d.columns]
    popular = bounded(F.array_max(F.array(*betas)) / 1.5, 0.0, 1.0) if betas else F.lit(0.0)
    recipe = _looked_up(d["family"], FAMILIES) if "family" in d.columns else F.lit(0.5)
    room, turnover = known(d, "capacity_usd"), known(d, "annual_turnover")
    scale = F.when(room.isNull(), 0.5).otherwise(bounded(F.log10(F.greatest(room, F.lit(1e6)) / 1e6) / 3, 0.0, 1.0))
    scale = F.when(turnover > 0, scale * bounded(1 - (turnover - 2) / 20, 0.0, 1.0)).otherwise(scale)
    out = d.withColumn("score", 100 * (0.45 * popular + 0.30 * recipe + 0.25 * scale))
    return out.withColumn("verdict", F.when(F.col("score") >= 70, "HIGH").when(F.col("score") >= 45, "MODERATE").otherwise("LOW"))


def survival(d: DataFrame) -> DataFrame:
    """Adds probability, verdict and weakest_link: the geometric mean of what is known of pbo, psr, edge_decay_slope,
    crash_ratio, crowding_score and phase, each from 0 to 1 and no less than 0.05. Ties for the weakest go to the first."""
    inside = lambda c: F.when(c.isNotNull(), bounded(c, 0.0, 1.0))
    x = lambda name: known(d, name)
    parts = {
        "not_overfit": inside(1 - x("pbo")),
        "significant": inside(x("psr")),
        "not_decaying": inside((x("edge_decay_slope") + 0.5) / 0.7),
        "crisis_robust": inside(x("crash_ratio")),
        "uncrowded": inside(1 - x("crowding_score") / 100),
        "lifecycle": F.when(d["phase"] != "", _looked_up(d["phase"], PHASES)) if "phase" in d.columns else F.lit(None).cast("double"),
    }
    every = F.array(*[F.struct(v.alias("share"), F.lit(i).alias("i"), F.lit(k).alias("name")) for i, (k, v) in enumerate(parts.items())])
    out = d.withColumn("_parts", F.filter(every, lambda p: p["share"].isNotNull()))
    logs = F.aggregate("_parts", F.lit(0.0), lambda a, p: a + F.ln(F.greatest(p["share"], F.lit(0.05))))
    p = F.exp(F.try_divide(logs, F.size("_parts")))
    out = out.withColumn("probability", p).withColumn("weakest_link", F.array_min("_parts")["name"]).drop("_parts")
    p = F.col("probability")
    return out.withColumn("verdict", F.when(p.isNull(), "INSUFFICIENT_DATA").when(p >= 0.65, "LIKELY_DURABLE").when(p >= 0.45, "UNCERTAIN").otherwise("AT_RISK"))


def geometric_mean(parts: Sequence[tuple[Column, float]], floor: float = 0.1) -> Column:
    """The weighted geometric mean of columns, each lifted by `floor` and no less than it."""
    total = reduce(lambda a, b: a + b, [w * F.ln(F.greatest(v + floor, F.lit(floor))) for v, w in parts])
    return F.exp(total / sum(w for _, w in parts))


def composite(d: DataFrame) -> DataFrame:
    """Adds `composite`: the weighted geometric mean of nine pillars from 0 to 10.

    Reads psr, upi, stability, rolling_consistency, sortino, calmar, trades, cagr and recency. The first five count as the
    middle of their range where unknown, the others as zero.
    """
    x = lambda name: F.coalesce(known(d, name), F.lit(0.0))
    ten = lambda c: bounded(c, 0.0, 10.0)
    span = lambda k, a, b: ten((F.coalesce(known(d, k), F.lit((a + b) / 2)) - a) / (b - a) * 10)
    parts = [(span(k, *ab), 3.0 if k == "psr" else 1.0) for k, ab in RANGES.items()]
    parts += [
        (F.sqrt(bounded(x("calmar"), 0.0, 2.0) / 2) * 10, 1.0),
        (ten(F.log10(1 + F.greatest(x("trades"), F.lit(0.0))) / F.log10(F.lit(10001.0)) * 10), 1.2),
        (ten(x("cagr") / 0.2 * 10), 1.5),
        (ten((x("recency") + 1) / 3 * 10), 1.0),
    ]
    return d.withColumn("composite", geometric_mean(parts))


def floors(d: DataFrame, least: dict[str, float], most: dict[str, float] | None = None, hedge: str | None = None) -> DataFrame:
    """Adds `reasons`, the metrics under their floor or over their ceiling; a row without any is kept.

    An unknown metric misses its floor and never breaks its ceiling. Rows whose `hedge` column is true need no floor.
    """
    free = _is(F.col(hedge)) if hedge else F.lit(False)
    under = [F.when(~free & ~_is(known(d, k) >= v), k) for k, v in least.items()]
    over = [F.when(known(d, k) > v, k) for k, v in (most or {}).items()]
    return d.withColumn("reasons", F.array_compact(F.array(*under, *over)))
