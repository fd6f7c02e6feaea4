"""Derived finance views over the driver's tables: returns, prices, ticks, bars, spans; in Spark and in SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators import panel

CTES = {
    "rets": """SELECT run_id, dt, round(0.02 * (v / avg(v) OVER (PARTITION BY run_id) - 1) + 0.0003, 10) AS r
        FROM (SELECT l_returnflag AS run_id, CAST(l_shipdate AS DATE) AS dt, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1, 2)""",
    "dd": """SELECT *, exp(le - max(le) OVER (PARTITION BY run_id ORDER BY dt)) - 1 AS drawdown
        FROM (SELECT *, sum(ln(1 + r)) OVER (PARTITION BY run_id ORDER BY dt) AS le FROM rets)""",
    "px": """SELECT symbol, dt, round(100 * exp(sum(lr) OVER (PARTITION BY symbol ORDER BY dt)), 6) AS price
        FROM (SELECT symbol, dt, round(0.02 * (a / avg(a) OVER (PARTITION BY symbol) - 1) + 0.0003, 10) AS lr
              FROM (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS a FROM orders GROUP BY 1, 2))""",
    "pr": "SELECT *, price / lag(price) OVER (PARTITION BY symbol ORDER BY dt) - 1 AS ret FROM px",
    "ticks": """SELECT event_type AS symbol, ts, event_id AS tick_id, value AS price, 1.0::DOUBLE AS qty,
        CASE WHEN user_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CAST(ts AS DATE) AS session FROM events WHERE value IS NOT NULL""",
    "bars": """SELECT symbol, session, date_trunc('hour', ts) AS bar, first(price ORDER BY ts, tick_id) AS open, max(price) AS high, min(price) AS low,
        last(price ORDER BY ts, tick_id) AS close, sum(qty) AS volume, count(*) AS trades FROM ticks GROUP BY 1, 2, 3""",
    "spans": """SELECT o_custkey AS member, CAST(min(o_orderdate) AS DATE) AS start_dt,
        CASE WHEN o_custkey % 3 <> 0 THEN CAST(max(o_orderdate) AS DATE) END AS end_dt FROM orders GROUP BY o_custkey""",
    "wide": """SELECT dt, max(CASE WHEN run_id = 'A' THEN r END) AS a, max(CASE WHEN run_id = 'N' THEN r END) AS n, max(CASE WHEN run_id = 'R' THEN r END) AS f
        FROM rets GROUP BY dt HAVING count(DISTINCT run_id) = 3""",
    "grid": "SELECT 10 AS fast UNION ALL SELECT 20 UNION ALL SELECT 40 UNION ALL SELECT 60",
    "gsim": """SELECT fast, symbol, dt, held * coalesce(ret, 0) - 0.001 * abs(w - held) AS r FROM (
        SELECT *, lag(w) OVER (PARTITION BY fast, symbol ORDER BY dt) AS held, row_number() OVER (PARTITION BY fast, symbol ORDER BY dt) AS rn FROM (
            SELECT *, CASE WHEN rn0 >= fast AND price > (s - lagged) / fast THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS w FROM (
                SELECT *, coalesce(max(s) OVER (PARTITION BY fast, symbol ORDER BY rn0 RANGE BETWEEN fast PRECEDING AND fast PRECEDING), 0) AS lagged FROM (
                    SELECT grid.fast, pr.*, sum(price) OVER (PARTITION BY fast, symbol ORDER BY dt) AS s, row_number() OVER (PARTITION BY fast, symbol ORDER BY dt) AS rn0 FROM pr CROSS JOIN grid)))) WHERE rn > 1""",
    "sig": """SELECT symbol, dt, price, ret, round(price / lag(price, 10) OVER w - 1, 10) AS signal, round(lead(price) OVER w / price - 1, 10) AS fwd
        FROM pr WINDOW w AS (PARTITION BY symbol ORDER BY dt)""",
}


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def rets(self) -> DataFrame:
        g = self.table("lineitem").groupBy(F.col("l_returnflag").alias("run_id"), F.to_date("l_shipdate").alias("dt"))
        g = g.agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
        r = F.round(F.lit(0.02) * (F.col("v") / F.avg("v").over(Window.partitionBy("run_id")) - 1) + F.lit(0.0003), 10)
        return g.select("run_id", "dt", r.alias("r"))

    @cached_property
    def px(self) -> DataFrame:
        g = self.table("orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("dt")).agg(F.avg("o_totalprice").alias("a"))
        g = g.withColumn("lr", F.round(F.lit(0.02) * (F.col("a") / F.avg("a").over(Window.partitionBy("symbol")) - 1) + F.lit(0.0003), 10))
        w = panel.along("symbol").rowsBetween(Window.unboundedPreceding, 0)
        return g.select("symbol", "dt", F.round(100 * F.exp(F.sum("lr").over(w)), 6).alias("price"))

    @cached_property
    def pr(self) -> DataFrame:
        return self.px.withColumn("ret", panel.pct_change("price", panel.along("symbol")))

    @cached_property
    def ticks(self) -> DataFrame:
        return self.ticks_of(self.table("events"))

    def ticks_of(self, events: DataFrame) -> DataFrame:
        side = F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell")
        e = events.where("value is not null")
        return e.select(F.col("event_type").alias("symbol"), "ts", F.col("event_id").alias("tick_id"), F.col("value").alias("price"), F.lit(1.0).alias("qty"), side.alias("side"), F.to_date("ts").alias("session"))

    @cached_property
    def bars(self) -> DataFrame:
        return panel.ohlcv(self.ticks, F.date_trunc("hour", "ts"), ("symbol", "session"))

    @cached_property
    def spans(self) -> DataFrame:
        g = self.table("orders").groupBy(F.col("o_custkey").alias("member")).agg(F.to_date(F.min("o_orderdate")).alias("start_dt"), F.to_date(F.max("o_orderdate")).alias("end_dt"))
        return g.withColumn("end_dt", F.when(F.col("member") % 3 != 0, F.col("end_dt")))

    @cached_property
    def wide(self) -> DataFrame:
        one = lambda k: F.max(F.when(F.col("run_id") == k, F.col("r")))
        return self.rets.groupBy("dt").agg(one("A").alias("a"), one("N").alias("n"), one("R").alias("f")).where("a is not null and n is not null and f is not null")

    @cached_property
    def sig(self) -> DataFrame:
        w = panel.along("symbol")
        return self.pr.withColumn("signal", F.round(F.col("price") / F.lag("price", 10).over(w) - 1, 10)).withColumn("fwd", F.round(F.lead("price").over(w) / F.col("price") - 1, 10))
