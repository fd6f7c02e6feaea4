"""Parameter grids as tables: every combination is a row, numbered, with the place of each parameter's level.

A grid maps parameters to their levels in order. Nothing but the levels is on the driver: combinations are column expressions
of a range, thinned by taking fewer places along each axis, sampled by a low-discrepancy sequence, and refined around the
best rows by equal places.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .book_search import sobol


def counts(sizes: list[int], most: int) -> list[int]:
    """How many levels of each axis to take so that at most `most` combinations are left: one level for all axes alike, cut off at
    their lengths, as high as fits; then one more for the axes that have it, first axis first, while that fits."""
    level = 1
    while level < max(sizes, default=1) and prod(min(s, level + 1) for s in sizes) <= most:
        level += 1
    out = [min(s, level) for s in sizes]
    for i, s in enumerate(sizes):
        if out[i] < s and prod(out) // out[i] * (out[i] + 1) <= most:
            out[i] += 1
    return out


def lattice(spark: SparkSession, grid: dict[str, list], most: int | None = None) -> DataFrame:
    """(combo, parameters, places): combinations in the order of the levels; places: one struct of level numbers, from 0.

    most: at most so many combinations, levels spread evenly with both ends (one level: the first). An axis without levels
    gives no combination.
    """
    sizes = [len(x) for x in grid.values()]
    if not all(sizes):
        return spark.range(0).select(F.col("id").alias("combo"), *[F.lit(None).alias(p) for p in grid], F.struct(*[F.lit(0).alias(p) for p in grid]).alias("places"))
    take = sizes if most is None else counts(sizes, most)
    step, columns, places = prod(take), [], []
    for (name, levels), c in zip(grid.items(), take):
        step //= c
        nth = F.floor(F.col("id") / step) % c
        place = (F.floor(nth * (len(levels) - 1) / (c - 1)) if c > 1 else F.lit(0)).cast("int")
        places.append(place.alias(name))
        columns.append(F.element_at(F.array(*map(F.lit, levels)), place + 1).alias(name))
    return spark.range(prod(take)).select(F.col("id").alias("combo"), *columns, F.struct(*places).alias("places"))


def sampled(combos: DataFrame, n: int) -> DataFrame:
    """At most n of the combinations (numbered from 0), evenly spread: those that the first points of Sobol's sequence fall on."""
    total = combos.count()
    if n >= total:
        return combos
    points = sobol(combos.sparkSession, 4 * total, 1)  # the sequence visits every cell of a power of two once, so all combinations come up
    first = points.groupBy(F.floor(F.col("u")[0] * total).alias("combo")).agg(F.min("point").alias("point"))
    return combos.join(first.orderBy("point").limit(n).select("combo"), "combo", "left_semi")


def neighbours(combos: DataFrame, best: DataFrame, keys: list[str], span: int = 1) -> DataFrame:
    """(keys, combination) of every combination whose levels all lie within `span` places of a key's best one.

    best: keys and the parameters. A best row that is no combination has no neighbours; a key's combinations come once.
    """
    params = combos.select("places.*").columns
    d = best.select(*keys, *params).join(combos.select(*params, "places"), params).select(*keys, F.col("places").alias("at"))
    for p in params:
        d = d.withColumn(f"_{p}", F.explode(F.sequence(F.col(f"at.{p}") - span, F.col(f"at.{p}") + span)))
    near = d.select(*keys, F.struct(*[F.col(f"_{p}").cast("int").alias(p) for p in params]).alias("places")).distinct()
    return near.join(combos, "places").select(*keys, "combo", *params)


def distinct_settings(rows: DataFrame, keys: list[str], params: list[str], score: str) -> DataFrame:
    """rows without repeated parameters: of equal ones the row of greatest score (null last), then of the least combo, stays."""
    of = Window.partitionBy(*keys, *params)
    return rows.withColumn("_n", F.row_number().over(of.orderBy(F.desc_nulls_last(score), "combo"))).where("_n = 1").drop("_n")
