"""k-means over parameter sets as rounds of joins and sums, several starts at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import digest


def parameter_clusters(rows: DataFrame, family: str, config: str, params: list[str], score: str, top: float = 0.2, clusters: int | None = None, rounds: int = 12, starts: int = 5) -> DataFrame:
    """(family, cluster, size, mean_score, best_score, inertia, params): centres of the best configurations of every family.

    Of each family the best `top` share by score (two at least; ties to the smaller config) is scaled to 0..1 a parameter and
    clustered; there are as many clusters as given, or the root of the number of rows, two at least and no more than rows. A
    start takes the configurations of least digest as centres; a round assigns every row to its nearest centre (the lower
    number, where two are as near) and moves centres to their means; one without rows stays. Of the starts the one of least
    inertia stays (the lower number, where two are equal). Centres travel as one row a family and start, so rows are never
    shuffled but as sums. Nulls count as the family's least value; a parameter of one value throughout counts as 0.
    """
    of = Window.partitionBy(family)
    by = of.orderBy(F.desc_nulls_last("score"), "_config")
    d = rows.select(family, F.col(config).alias("_config"), F.col(score).cast("double").alias("score"), *[F.col(p).cast("double").alias(p) for p in params])
    d = d.withColumn("place", F.row_number().over(by)).withColumn("n", F.greatest(F.lit(2), F.floor(F.count("*").over(of) * F.lit(top)))).where("place <= n")
    least, most = ({p: f(p).over(of) for p in params} for f in (F.min, F.max))
    x = F.array(*[F.coalesce((F.col(p) - least[p]) / F.nullif(most[p] - least[p], F.lit(0.0)), F.lit(0.0)) for p in params])
    ends = F.array(*[F.struct(least[p].alias("lo"), (most[p] - least[p]).alias("span")) for p in params])
    d = d.withColumn("x", x).withColumn("ends", ends).withColumn("here", F.count("*").over(of)).where("here >= 2")
    k = F.lit(clusters) if clusters else F.greatest(F.lit(2), F.floor(F.sqrt("here")))
    d = d.withColumn("k", F.least(k, F.col("here")).cast("int"))
    begun = d.withColumn("start", F.explode(F.sequence(F.lit(0), F.lit(starts - 1)))).withColumn("c", F.row_number().over(Window.partitionBy(family, "start").orderBy(digest("start", "_config"), "_config")) - 1)
    centres = begun.where("c < k").groupBy(family, "start").agg(F.array_sort(F.collect_list(F.struct("c", "x"))).alias("centres"))

    def assigned(centres: DataFrame) -> DataFrame:
        far = lambda a, b: F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)
        near = F.array_min(F.transform("centres", lambda e: F.struct(far(F.col("x"), e["x"]).alias("far"), e["c"].alias("c"))))
        return d.join(centres, family).withColumn("near", near)

    for _ in range(rounds):
        means = F.array(*[F.avg(F.col("x")[i]) for i in range(len(params))])
        moved = assigned(centres).groupBy(family, "start", F.col("near.c").alias("c")).agg(means.alias("x"), F.first("centres").alias("old"))
        moved = moved.groupBy(family, "start").agg(F.first("old").alias("old"), F.map_from_entries(F.collect_list(F.struct("c", "x"))).alias("new"))
        centres = moved.select(family, "start", F.transform("old", lambda e: F.struct(e["c"].alias("c"), F.coalesce(F.try_element_at(F.col("new"), e["c"]), e["x"]).alias("x"))).alias("centres"))
    last = assigned(centres)
    stats = last.groupBy(family, "start", F.col("near.c").alias("cluster")).agg(F.count("*").alias("size"), F.avg("score").alias("mean_score"), F.max("score").alias("best_score"), F.sum("near.far").alias("part"), F.first("ends").alias("ends"), F.first(F.get("centres", F.col("near.c"))["x"]).alias("x"))
    stats = stats.withColumn("inertia", F.sum("part").over(Window.partitionBy(family, "start")))
    best = stats.withColumn("won", F.min(F.struct(F.round("inertia", 12).alias("i"), "start")).over(of)).where("start = won.start")
    centre = [(F.col("ends")[i]["lo"] + F.col("x")[i] * F.col("ends")[i]["span"]).alias(p) for i, p in enumerate(params)]
    return best.select(family, "cluster", "size", "mean_score", "best_score", "inertia", *centre)
