"""Queries: files, registry, lineage, streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.sources import files, registry, snapshots, synthetic
from tessella.streaming import bars

from .registry import query


@query("run_id dt", "", "r", "SELECT * FROM rets", "rets", places=12)
def csv_round_trip(v):
    path = files.new_path(v.spark, "returns")
    v.rets.write.option("header", True).csv(path)
    return files.read_csv(v.spark, path, "run_id string, dt date, r double")


@query("run_id dt", "", "r", "SELECT * FROM rets WHERE dt BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", "rets", places=12)
def as_of_scan(v):
    path = files.new_path(v.spark, "panel")
    v.rets.write.partitionBy("run_id").parquet(path)
    return files.as_of(v.spark.read.parquet(path), "1998-12-31", "1996-01-01")


_MODELS = """(SELECT substr(sha256('{"slug":"' || c_mktsegment || '","version":' || c_custkey || '}'), 1, 12) AS model_id, c_mktsegment AS slug, c_custkey AS version, c_acctbal AS score FROM customer)"""


@query("slug model_id", "", "score", f"SELECT slug, model_id, score FROM {_MODELS} QUALIFY row_number() OVER (PARTITION BY slug ORDER BY version DESC) = 1")
def registry_latest(v):
    m = v.table("customer").select(F.col("c_mktsegment").alias("slug"), F.col("c_custkey").alias("version"), "c_acctbal")
    at = F.timestamp_seconds(F.col("version"))
    m = m.select(registry.model_id("slug", "version").alias("model_id"), "slug", F.col("version").cast("string").alias("version"), at.alias("created_at"), F.create_map(F.lit("score"), "c_acctbal").alias("metrics"))
    path = files.new_path(v.spark, "models")
    registry.record(m, path)
    return registry.latest(registry.load(v.spark, path)).withColumn("score", F.col("metrics")["score"])


@query("", "node root depth", "", """SELECT node, root, depth FROM (WITH RECURSIVE t(node, root, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey % 7 = 0 UNION ALL SELECT c_custkey, root, depth + 1 FROM customer JOIN t ON c_custkey = node + 1 WHERE c_custkey % 7 <> 0) SELECT * FROM t)""")
def lineage(v):
    key = F.col("c_custkey")
    return registry.lineage(v.table("customer").select(key, F.when(key % 7 != 0, key - 1).alias("parent")), "c_custkey", "parent")


@query("symbol bar", "trades", "open high low close volume", "SELECT symbol, date_trunc('hour', ts) AS bar, first(price ORDER BY ts, tick_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, tick_id) AS close, sum(qty) AS volume, count(*) AS trades FROM ticks GROUP BY 1, 2", "ticks")
def streaming_bars(v):
    ticks = v.spark.readStream.schema(v.table("events").schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    out = bars.run_once(bars.streaming_bars(v.ticks_of(ticks.withColumn("ts", F.col("ts").cast("timestamp")))), v.spark)
    return out.withColumn("bar", F.col("bar").cast(v.table("events").schema["ts"].dataType))


@query("symbol dt", "", "price", None)
def synthetic_prices(v):
    return synthetic.prices(v.spark, ["A", "B", "C"], 500)


@query("run_id dt", "", "r", "SELECT run_id, CAST(dt AS VARCHAR) AS dt, r FROM rets", "rets", places=12)
def json_gz_round_trip(v):
    path = files.new_path(v.spark, "returns")
    v.rets.select("run_id", F.col("dt").cast("string").alias("dt"), "r").write.option("compression", "gzip").json(path)
    return files.read_json_lines(v.spark, path, "run_id string, dt string, r double")


@query("path sha256", "bytes", "", None)
def snapshot_manifest(v):
    """The stored bytes of the given tables, which SQL over their rows cannot see; tests hold it against hashlib."""
    return snapshots.manifest(v.spark, v.sf_dir, "*.parquet")
