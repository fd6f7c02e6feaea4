"""The model registry: appended JSON lines, the latest entry of every model, ids from content, lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import new_path, read_json_lines

SCHEMA = "model_id string, slug string, category string, version string, status string, parent_model_id string, created_at timestamp, metrics map<string, double>"


def model_id(*parts: Column | str) -> Column:
    """Twelve hex digits of the SHA-256 of the parts' JSON, keys in the given order."""
    return F.substring(F.sha2(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"}), 256), 1, 12)


def record(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, SCHEMA)


def latest(entries: DataFrame, key: str = "slug", at: str = "created_at") -> DataFrame:
    """The newest entry of each key; of equal times that with the largest model_id."""
    w = Window.partitionBy(key).orderBy(F.desc(at), F.desc("model_id"))
    return entries.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def lineage(models: DataFrame, node: str, parent: str, most_rounds: int = 40) -> DataFrame:
    """(node, root, depth): each node's oldest known ancestor and the steps to it.

    Pointers double: every round a node takes over its ancestor's ancestor, so a chain of d models takes log2(d) rounds of
    one equi-join. Nodes on a cycle, or below one, come back with a null root and depth. A parent that is no node is a root.
    """
    spark = models.sparkSession
    d = models.groupBy(F.col(node).alias("node")).agg(F.max(parent).alias("up"))
    d = d.withColumn("depth", F.when(F.col("up").isNull(), F.lit(0)).otherwise(F.lit(1)).cast("long")).withColumn("open", F.col("up").isNotNull())
    d = d.withColumn("up", F.coalesce("up", "node"))
    total, left = d.count(), None
    for _ in range(most_rounds):
        path = new_path(spark, "lineage")
        d.write.parquet(path)
        d = spark.read.schema(d.schema).parquet(path)
        left = d.where("open").count()
        if not left or (1 << _) > total:
            break
        a = d.select(F.col("node").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"), F.col("open").alias("more_open"))
        j = d.where("open").join(a, "up", "left")
        j = j.select("node", F.coalesce("next", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.coalesce("more_open", F.lit(False)).alias("open"))
        d = d.where("not open").unionByName(j)
    return d.select("node", F.when(~F.col("open"), F.col("up")).alias("root"), F.when(~F.col("open"), F.col("depth")).alias("depth"))
