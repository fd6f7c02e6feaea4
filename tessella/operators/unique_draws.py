"""Sequential bootstrap: labels drawn by uniqueness, each draw of one lowering its chance of the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import uniform


def sequential_bootstrap(labels: DataFrame, family: str, item: str, weight: str, draws: int = 1, per_item: int = 16, size: int | None = None) -> DataFrame:
    """(family, draw, place, item): `size` items (as many as the family has) drawn one after another, item i with chance in
    proportion to weight / (1 + times drawn before).

    Draws need no order of their own: give every item a clock that rings first after an exponential time of rate w, then of
    rate w / 2, w / 3 and so on. As waiting has no memory, which item rings next has just the wanted chance, so a draw is the
    rings of all items in order of time, and an item's rings depend on nothing but digests of (draw, item, ring). The first
    `per_item` rings of an item are taken; where one's last still falls among the draws, all are taken twice as far.

    Items of null or no positive weight are not drawn unless all are so, and then all weigh the same. A family is ranked by
    time in one window; an item may stand in it once.
    """
    of = Window.partitionBy(family)
    w = F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    d = labels.select(family, item, w.alias("w")).withColumn("all", F.sum("w").over(of)).withColumn("w", F.when(F.col("all") > 0, F.col("w")).otherwise(1.0)).withColumn("n", F.count("*").over(of)).where("w > 0")
    d = d.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    want = F.lit(size) if size is not None else F.col("n")
    while True:
        wait = F.transform(F.sequence(F.lit(1), F.lit(per_item)), lambda j: j * -F.ln(uniform(F.lit("ring"), "draw", F.col(item).cast("string"), j)) / F.col("w"))
        times = F.aggregate(wait, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(x + F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
        rung = d.select(family, item, "draw", "n", F.posexplode(times).alias("ring", "time"))
        ranked = rung.withColumn("place", F.row_number().over(Window.partitionBy(family, "draw").orderBy("time", item))).where(F.col("place") <= want)
        if not ranked.where(F.col("ring") == per_item - 1).limit(1).count():
            return ranked.select(family, "draw", "place", item)
        per_item *= 2
