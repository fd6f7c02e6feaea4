"""Bars from a stream of ticks: watermarked tumbling windows, kept as the newest state of every bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import panel
from tessella.sources.files import new_path


def streaming_bars(ticks: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Open, high, low, close, volume and trades per symbol and window of a streaming frame (symbol, ts, tick_id, price, qty)."""
    return panel.ohlcv(ticks.withWatermark("ts", late), F.window("ts", size)).withColumn("bar", F.col("bar.start"))


def run_once(bars: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs the stream over all that is there and returns every bar's newest state.

    Batches are written under their number, so a batch that runs twice replaces itself; update mode hands on a bar each
    time that it changes, and the newest batch decides.
    """
    out, state = new_path(spark, "bars"), new_path(spark, "bars-state")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = bars.writeStream.outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    w = Window.partitionBy("symbol", "bar").orderBy(F.desc("batch"))
    return spark.read.parquet(out).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "batch")
