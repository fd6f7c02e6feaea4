"""One trade a session: fading a strong opening, and reverting to the session's VWAP once a trend tires; the session's regime.

bars: symbol, session, bar, open, high, low, close, volume. What a session knows beforehand is the average true range, the high and the
low of the sessions before it. Both rules put an entry, a stop and a target; `intrabar.first_touch` says how it went.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import intrabar, panel
from .signals import ewm
from .strategies import directional_index

KEYS = ["symbol", "session"]


def known_before(bars: DataFrame, n: int = 14) -> DataFrame:
    """(symbol, session, atr, prior_high, prior_low, bars): Wilder's average true range over the `n` sessions and more before, null
    until there are as many, and the session before's extremes."""
    s = bars.groupBy(*KEYS).agg(F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "bar").alias("close"), F.count("*").alias("bars"))
    w = panel.along("symbol", "session")
    prev = F.lag("close").over(w)
    reach = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    s = s.withColumn("range", reach)
    mean = ewm(s, "symbol", "range", 1 / n, "session").withColumnRenamed("ewm", "atr")
    s = s.join(mean, KEYS).withColumn("atr", F.when(F.row_number().over(w) >= n, F.col("atr")))
    return s.select(*KEYS, F.lag("atr").over(w).alias("atr"), F.lag("high").over(w).alias("prior_high"), F.lag("low").over(w).alias("prior_low"), "bars")


def _told(before: DataFrame, entries: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, session, entries, side, outcome, pnl, worst) of every session; those without a trade have 0 entries, side, pnl and worst, and no_entry."""
    done = intrabar.first_touch(entries, bars).select(*KEYS, "side", "outcome", "pnl", "worst")
    out = before.select(*KEYS).join(done, KEYS, "left")
    zero = F.lit(0.0)
    return out.select(*KEYS, F.col("outcome").isNotNull().cast("int").alias("entries"), F.coalesce("side", F.lit(0)).alias("side"), F.coalesce("outcome", F.lit("no_entry")).alias("outcome"), F.coalesce("pnl", zero).alias("pnl"), F.coalesce("worst", zero).alias("worst"))


def _ordered(entries: DataFrame, distance, reward: float) -> DataFrame:
    d = entries.withColumn("_far", distance)
    return d.select(*KEYS, "bar", "entry", "side", (F.col("entry") - F.col("_far") * F.col("side")).alias("stop"), (F.col("entry") + F.col("_far") * reward * F.col("side")).alias("target"))


def opening_fade(bars: DataFrame, minutes: int = 30, reward: float = 1.5, least: float = 0.4, most: float | None = None, cap: float | None = None, from_bar: int = 0) -> DataFrame:
    """Against the opening move, where it is at least `least` (and at most `most`) average ranges.

    The move runs from the session's open to the close of its last bar that begins within `minutes` of the first, or of bar
    `from_bar` where that is later. The stop is as far as the move (at most `cap` ranges), the target `reward` times that. Sessions
    of under five bars, without a range, or whose move takes all their bars have no trade.
    """
    before = known_before(bars)
    of = Window.partitionBy(*KEYS)
    b = bars.withColumn("k", F.row_number().over(of.orderBy("bar"))).withColumn("n", F.count("*").over(of)).withColumn("begin", F.min("bar").over(of)).withColumn("opened", F.min_by("open", "bar").over(of))
    early = F.unix_timestamp("bar") - F.unix_timestamp("begin") <= 60 * minutes
    b = b.withColumn("last", F.greatest(F.count_if(early).over(of), F.lit(from_bar + 1))).where((F.col("k") == F.col("last")) & (F.col("last") < F.col("n")) & (F.col("n") >= 5))
    move = F.col("close") - F.col("opened")
    d = b.join(before.select(*KEYS, "atr"), KEYS).withColumn("move", move).where((F.col("atr") > 0) & (F.abs("move") >= least * F.col("atr")))
    d = d.where(F.abs("move") <= most * F.col("atr")) if most is not None else d
    d = d.withColumn("side", F.when(F.col("move") > 0, -1).otherwise(1)).withColumn("entry", F.col("close"))
    far = F.abs("move") if cap is None else F.least(F.abs("move"), cap * F.col("atr"))
    return _told(before, _ordered(d, far, reward), bars)


def tired_trend(bars: DataFrame, back: int = 3, strong: float = 25.0, stretch: float = 1.0, reward: float = 1.5, stop: float = 0.5) -> DataFrame:
    """Towards the VWAP at the session's first bar where the directional index, at `strong` or more `back` bars ago, has fallen, the close
    is `stretch` of its deviations so far away, and the bar reaches the session before's extreme on that side.

    The stop is `stop` average ranges away, the target `reward` times that. Sessions without a range or a session before have none.
    """
    before = known_before(bars)
    of = Window.partitionBy(*KEYS).orderBy("bar")
    d = panel.session_vwap(bars).join(directional_index(bars), ["symbol", "bar"])
    d = d.withColumn("k", F.row_number().over(of)).withColumn("was", F.lag("adx", back).over(of)).withColumn("off", F.col("close") - F.col("vwap"))
    d = d.join(before.where("atr > 0 and prior_high is not null"), KEYS)
    tired = (F.col("k") > back) & (F.col("was") >= strong) & (F.col("adx") < F.col("was")) & (F.col("band") > 0)
    above = (F.col("high") >= F.col("prior_high")) & (F.col("off") >= stretch * F.col("band"))
    below = (F.col("low") <= F.col("prior_low")) & (F.col("off") <= -stretch * F.col("band"))
    d = d.withColumn("side", F.when(tired & above, -1).when(tired & below, 1)).where("side is not null").withColumn("nth", F.row_number().over(of)).where("nth = 1")
    return _told(before, _ordered(d.withColumn("entry", F.col("close")), stop * F.col("atr"), reward), bars)


def session_regime(bars: DataFrame, stretch: float = 1.5, first: int = 12) -> DataFrame:
    """(symbol, session, regime): 1 for a trend, where closes lie `stretch` or more deviations from the VWAP on average over the `first`
    bars, 0 for reversion, -1 where no bar has a deviation yet."""
    d = panel.session_vwap(bars).withColumn("k", F.row_number().over(Window.partitionBy(*KEYS).orderBy("bar"))).where(F.col("k") <= first)
    far = F.when(F.col("band") > 0, F.abs((F.col("close") - F.col("vwap")) / F.col("band")))
    mean = F.avg(far)
    return d.groupBy(*KEYS).agg(F.when(mean.isNull(), -1).when(mean >= stretch, 1).otherwise(0).alias("regime"))


def routed(bars: DataFrame, stretch: float = 1.5, first: int = 12, **fade) -> DataFrame:
    """(symbol, session, regime, entries, pnl, worst): the opening fade in sessions that revert, and nothing in the others; the fade enters
    at bar `first` at the earliest, when the regime is known."""
    trades = opening_fade(bars, from_bar=first, **fade)
    d = trades.join(session_regime(bars, stretch, first), KEYS)
    on = F.col("regime") == 0
    return d.select(*KEYS, "regime", *[F.when(on, F.col(x)).otherwise(F.lit(0)).alias(x) for x in ("entries", "pnl", "worst")])
