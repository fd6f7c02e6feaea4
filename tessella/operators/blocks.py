"""Block resamples from prefix sums.

Blocks are drawn from digests of (draw, block), so every engine, partitioning and retry draws the same ones. A block's sum
is the difference of two prefix sums, so a resample costs a row or two a block instead of one a bar, and the resamples of a
series never gather in one task. Families share their draws: keys of the same length see the same blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import along


def digest(*parts) -> Column:
    """32 bits of the MD5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def uniform(*parts) -> Column:
    """In (0, 1), from `digest`."""
    return (digest(*parts) + 0.5) / 4294967296.0


def numbered(returns: DataFrame, keys: list[str], order: str = "dt") -> DataFrame:
    return returns.withColumn("i", (F.row_number().over(along(keys, order)) - 1).cast("long"))


def lagged_products(rows: DataFrame, key: str, lags: str) -> DataFrame:
    """(key, k, c): sums of e e' over bars k apart, k from 1 to the key's `lags`. rows: key, i, e, lags."""
    each = F.when(F.col(lags) >= 1, F.sequence(F.lit(1).cast("long"), F.col(lags).cast("long"))).otherwise(F.array().cast("array<long>"))
    a = rows.select(key, "i", "e", F.explode(each).alias("k"))
    b = rows.select(key, F.col("i").alias("j"), F.col("e").alias("f"))
    return a.withColumn("j", F.col("i") - F.col("k")).join(b, [key, "j"]).groupBy(key, "k").agg(F.sum(F.col("e") * F.col("f")).alias("c"))


def circular_blocks(sizes: DataFrame, draws: int, block: int | Column) -> DataFrame:
    """(keys, n, draw, start, len) of sizes (keys, n): blocks of one length, the last cut to what is missing. The length may be
    a column of `sizes`."""
    block = F.lit(block) if isinstance(block, int) else block
    sizes = sizes.withColumn("_block", block.cast("long"))
    block = F.col("_block")
    d = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / block))))
    return d.withColumn("start", digest("draw", "block") % F.col("n")).withColumn("len", F.least(block, F.col("n") - F.col("block") * block)).drop("block", "_block")


def stationary_blocks(sizes: DataFrame, draws: int, block: float) -> DataFrame:
    """(keys, n, draw, start, len): blocks of geometric length, `block` (over 1) on average, at starts of equal chance.

    Of n / block + 8 sqrt(n / block) + 16 blocks a draw, those that begin within n stay; the last goes on to n.
    """
    keys = [x for x in sizes.columns if x != "n"]
    most = F.ceil(F.col("n") / block + 8 * F.sqrt(F.col("n") / block) + 16)
    d = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0), (most - 1).cast("int"))))
    d = d.withColumn("len", (1 + F.floor(F.ln(uniform(F.lit("len"), "draw", "block")) / math.log(1 - 1 / block))).cast("long"))
    of = along([*keys, "draw"], "block")
    d = d.withColumn("upto", F.sum("len").over(of.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") - F.col("len") < F.col("n"))
    last = F.lead("upto").over(of).isNull()
    length = F.when(last, F.col("n") - F.col("upto") + F.col("len")).otherwise(F.col("len"))
    return d.select(*keys, "n", "draw", (digest(F.lit("at"), "draw", "block") % F.col("n")).alias("start"), length.alias("len"))


def block_sums(rows: DataFrame, family: list[str], columns: list[str], blocks: DataFrame, series: list[str] = ()) -> DataFrame:
    """(family, series, draw, n, columns): the columns' sums over each draw's blocks, which wrap round the end.

    rows: family, series, i (from 0, without gaps), columns. blocks: family, n, draw, start, len.
    """
    upto = along([*family, *series], "i").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.select(*family, *series, (F.col("i") + 1).alias("edge"), *[F.sum(x).over(upto).alias(x) for x in columns])
    end = F.col("start") + F.col("len")
    edges = F.array(*[F.struct(e.alias("edge"), F.lit(s).alias("sign")) for e, s in ((F.col("start"), -1), (F.least(end, F.col("n")), 1), (end - F.col("n"), 1))])
    picks = blocks.withColumn("e", F.explode(edges)).select(*family, "n", "draw", "e.edge", "e.sign").where("edge > 0")
    d = picks.join(sums, [*family, "edge"]).groupBy(*family, *series, "draw")
    return d.agg(F.first("n").alias("n"), *[F.sum(F.col("sign") * F.col(x)).alias(x) for x in columns])


def family_sizes(rows: DataFrame, family: list[str]) -> DataFrame:
    return rows.groupBy(*family).agg((F.max("i") + 1).alias("n"))


def whole_units(rows: DataFrame, family: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows, sizes): rows with r in whole units, q their square and bars 1; sizes has n and the family's unit.

    Sums of whole numbers are exact in any order, and so are differences of prefix sums: series of a family with the same
    returns in a run of bars have the same sums there, whatever came before. A unit is at most 2**-47 of the family's largest
    |r|, and squares fit a decimal for some 3e8 bars a series. rows: family, i, r (finite).
    """
    top = F.greatest(F.max(F.abs("r")), F.lit(1e-30))
    sizes = rows.groupBy(*family).agg((F.max("i") + 1).alias("n"), F.pow(F.lit(2.0), F.floor(F.log2(top)) - 47).alias("unit"))
    r = F.round(F.col("r") / F.col("unit")).cast("long").cast("decimal(20,0)")
    d = rows.join(sizes.drop("n"), family).withColumn("r", r).drop("unit")
    return d.withColumn("q", F.col("r") * F.col("r")).withColumn("bars", F.lit(1).cast("long")), sizes


def sharpe_of_sums(ppy: float) -> Column:
    """The Sharpe ratio from sums of r, q and bars (of at least one bar) in the `unit` of `whole_units`.

    Squares are centred on the whole part of the mean before anything is rounded, so a run of equal returns has no variance.
    """
    r, n, mean = F.col("r"), F.col("bars"), F.expr("r div bars")
    rest = r - mean * n
    around = (F.col("q") - mean * (r + rest)).cast("double") - rest.cast("double") ** 2 / n
    var = around / F.nullif(n - 1, F.lit(0))
    return F.when(var * F.col("unit") ** 2 > 1e-24, r.cast("double") / n / F.sqrt(var) * F.sqrt(F.lit(float(ppy)))).otherwise(0.0)
