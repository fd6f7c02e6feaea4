"""Panel operators over long tables keyed by run/symbol and date."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def along(keys: str | Sequence[str], order: str = "dt"):
    return Window.partitionBy(*([keys] if isinstance(keys, str) else keys)).orderBy(order)


def rolling(value: Column, n: int, over, fn=F.avg, need: int | None = None) -> Column:
    """fn over the last n rows; null until `need` (default n) of them have a value."""
    frame = over.rowsBetween(1 - n, 0)
    return F.when(F.count(value).over(frame) >= (need or n), fn(value).over(frame))


def ffill(value: Column | str, over) -> Column:
    return F.last(value, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def pct_change(value: str, over) -> Column:
    return F.try_divide(F.col(value), F.lag(value).over(over)) - 1


def ohlcv(ticks: DataFrame, bucket: Column, keys: Sequence[str] = ("symbol",), order: Sequence[str] = ("ts", "tick_id")) -> DataFrame:
    """Bars of ticks (ts, tick_id, price, qty): first, max, min, last, volume and count, ties in ts by tick_id."""
    at = F.struct(*order)
    return ticks.withColumn("bar", bucket).groupBy(*keys, "bar").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", at).alias("close"), F.sum("qty").alias("volume"), F.count("*").alias("trades"),
    )


def fill_buckets(bars: DataFrame, step: str = "1 hour", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """bars with a row for every bucket between a key's first and last: one without ticks has the close before as all four prices,
    and no volume and trades. Buckets are steps from the first bar on."""
    ends = bars.groupBy(*keys).agg(F.min("bar").alias("_lo"), F.max("bar").alias("_hi"))
    every = ends.select(*keys, F.explode(F.sequence("_lo", "_hi", F.expr(f"interval {step}"))).alias("bar"))
    d = every.join(bars, [*keys, "bar"], "left")
    close = ffill("close", along(list(keys), "bar"))
    d = d.withColumn("close", close)
    price = lambda x: F.coalesce(x, "close").alias(x)
    return d.select(*keys, "bar", price("open"), price("high"), price("low"), "close", F.coalesce("volume", F.lit(0.0)).alias("volume"), F.coalesce("trades", F.lit(0)).alias("trades"))


def order_flow(ticks: DataFrame, bucket: Column, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Buy and sell volume, their difference and trades; `side` is 'buy' or 'sell'."""
    buy, sell = (F.coalesce(F.sum(F.when(F.col("side") == s, F.col("qty"))), F.lit(0.0)) for s in ("buy", "sell"))
    out = ticks.withColumn("bar", bucket).groupBy(*keys, "bar").agg(buy.alias("buy_vol"), sell.alias("sell_vol"), F.count("*").alias("trades"))
    return out.withColumn("delta", F.col("buy_vol") - F.col("sell_vol"))


def session_vwap(bars: DataFrame, session: str = "session", order: str = "bar", keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Volume-weighted price from the session's start, and its expanding standard deviation band of close - vwap."""
    w = Window.partitionBy(*keys, session).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = bars.withColumn("vwap", F.try_divide(F.sum(typical * F.col("volume")).over(w), F.sum("volume").over(w)))
    return out.withColumn("band", F.stddev_samp(F.col("close") - F.col("vwap")).over(w))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], on: str, values: Sequence[str], inclusive: bool = True) -> DataFrame:
    """Every left row with the latest right values at or before its `on`.

    A union and one window, so both sides shuffle once by the keys; no inequality join.
    """
    side = F.lit(0 if inclusive else 2)
    r = right.select(*keys, on, side.alias("_side"), F.struct(*values).alias("_v"))
    extra = [x for x in left.columns if x not in {*keys, on}]
    both = left.select(*keys, on, F.lit(1).alias("_side"), *extra).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    return both.select(*left.columns, *[F.col(f"_v.{x}").alias(x) for x in values])


def members_on(members: DataFrame, days: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Days joined to the members whose interval holds them; the last day counts, a null end is open.

    The interval is binned by month, so the join is an equi-join with a filter instead of a nested loop.
    """
    last = days.agg(F.max("dt").alias("last"))
    m = members.crossJoin(F.broadcast(last)).withColumn("_to", F.coalesce(end, "last")).where(F.col("_to") >= F.col(start))
    m = m.withColumn("_m", F.explode(F.sequence(F.trunc(start, "MM"), F.trunc("_to", "MM"), F.expr("interval 1 month"))))
    d = days.withColumn("_m", F.trunc("dt", "MM"))
    return d.join(m, "_m").where(F.col("dt").between(F.col(start), F.col("_to"))).drop("_m", "_to", "last")


def islands(df: DataFrame, keys: str | Sequence[str], state: str, order: str = "dt") -> DataFrame:
    """Adds `island`: a number per maximal run of equal (null-safe) state."""
    w = along(keys, order)
    change = (~F.col(state).eqNullSafe(F.lag(state).over(w)) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_c", change).withColumn("island", F.sum("_c").over(w)).drop("_c")


def longest_run(df: DataFrame, keys: str, flag: Column, order: str = "dt") -> DataFrame:
    """(keys, longest): the longest run of consecutive true flags."""
    runs = islands(df.withColumn("_f", F.coalesce(flag, F.lit(False))), keys, "_f", order)
    n = runs.groupBy(keys, "island", "_f").count()
    return n.groupBy(keys).agg(F.coalesce(F.max(F.when(F.col("_f"), F.col("count"))), F.lit(0)).alias("longest"))


def adjust_prices(bars: DataFrame, dividends: DataFrame, splits: DataFrame) -> DataFrame:
    """Back-adjusted close. A factor applies on bars before an ex-date that is itself a bar's date; the bar before it sets
    the dividend's factor, floored at zero."""
    w = along("symbol")
    b = bars.join(dividends, ["symbol", "dt"], "left").join(splits, ["symbol", "dt"], "left").withColumn("prev", F.lag("close").over(w))
    f = F.greatest(F.lit(0.0), 1 - F.coalesce(F.try_divide(F.col("dividend"), F.col("prev")), F.lit(0.0))) / F.coalesce("ratio", F.lit(1.0))
    b = b.withColumn("_f", F.when(F.col("prev").isNull(), 1.0).otherwise(f))
    later = w.rowsBetween(1, Window.unboundedFollowing)
    zero = F.coalesce(F.max((F.col("_f") <= 0).cast("int")).over(later), F.lit(0)) == 1
    factor = F.when(zero, 0.0).otherwise(F.exp(F.coalesce(F.sum(F.when(F.col("_f") > 0, F.ln("_f"))).over(later), F.lit(0.0))))
    return b.withColumn("factor", factor).withColumn("adj_close", F.col("close") * F.col("factor")).drop("_f", "prev", "dividend", "ratio")


def parse_splits(events: DataFrame) -> DataFrame:
    """(symbol, dt, ratio) of split texts such as 2/1; texts that are no such ratio, or of zero, are left out."""
    part = lambda i: F.try_element_at(F.split("split", "/"), F.lit(i)).try_cast("double")
    d = events.select("symbol", "dt", F.try_divide(part(1), part(2)).alias("ratio"), F.size(F.split("split", "/")).alias("_n"))
    return d.where("_n = 2 and ratio > 0").drop("_n")


def membership_intervals(events: DataFrame) -> DataFrame:
    """(member, start_dt, end_dt) of a log (member, dt, action): from an addition while out to the removal after it, open at the end.

    Additions while in and removals while out change nothing.
    """
    w = along("member")
    turns = events.where("action in ('added', 'removed')").withColumn("before", F.lag("action").over(w))
    turns = turns.where("not (action <=> before) and not (before is null and action = 'removed')")
    return turns.withColumn("end_dt", F.lead("dt").over(w)).where("action = 'added'").select("member", F.col("dt").alias("start_dt"), "end_dt")


def positive_prices(bars: DataFrame, columns: Sequence[str] = ("open", "high", "low", "close")) -> DataFrame:
    """bars with prices of zero or less as nulls."""
    return bars.withColumns({x: F.when(F.col(x) > 0, F.col(x)) for x in columns if x in bars.columns})


def contract_violations(bars: DataFrame) -> DataFrame:
    """(symbol, dt, rule) of every breach: order and repetition of dates, positive prices, high/low bounds, volume."""
    w = Window.partitionBy("symbol", "dt")
    rules = {
        "duplicate_date": F.count("*").over(w) > 1,
        "nonpositive_price": F.least("open", "high", "low", "close") <= 0,
        "high_below_low": F.col("high") < F.col("low"),
        "open_outside": ~F.col("open").between(F.col("low"), F.col("high")),
        "close_outside": ~F.col("close").between(F.col("low"), F.col("high")),
        "negative_volume": F.col("volume") < 0,
        "missing_price": F.col("close").isNull(),
    }
    rule = F.filter(F.array(*[F.when(cond, name) for name, cond in rules.items()]), lambda x: x.isNotNull())
    return bars.withColumn("rule", rule).select("symbol", "dt", F.explode("rule").alias("rule"))


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, n, share): how often each value that is not null comes, and its share of the keys' rows."""
    d = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return d.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


def period_ends(df: DataFrame, period: str, key: str = "symbol") -> DataFrame:
    """The last row of every key in every calendar period (week, month, quarter, year), with the period's first day as `period`."""
    d = df.withColumn("period", F.to_date(F.date_trunc(period, "dt")))
    rest = F.struct("dt", *[x for x in df.columns if x not in (key, "dt")])
    return d.groupBy(key, "period").agg(F.max_by(rest, "dt").alias("row")).select(key, "period", "row.*")


def missing_dates(left: DataFrame, right: DataFrame) -> DataFrame:
    """(dt) of left that right does not hold, each once."""
    return left.select("dt").distinct().join(right.select("dt").distinct(), "dt", "left_anti")
