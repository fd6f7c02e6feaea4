"""A seeded generator of daily prices, as a function of spark.range and as a data source of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def normal(*parts, seed: int = 42):
    """A standard normal value from hashes of the parts (Box-Muller): the same on every run and partitioning."""
    unit = lambda k: (F.pmod(F.xxhash64(*parts, F.lit(seed), F.lit(k)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.ln(unit(1))) * F.cos(2 * 3.141592653589793 * unit(2))


def prices(spark: SparkSession, symbols: list[str], days: int, start: str = "2008-01-01", drift: float = 0.0003, vol: float = 0.01, seed: int = 42) -> DataFrame:
    """(symbol, dt, price): geometric random walks on business days, from 100."""
    d = spark.range(days * 7 // 5 + 7).select(F.date_add(F.lit(start).cast("date"), F.col("id").cast("int")).alias("dt")).where("weekday(dt) < 5")
    d = d.withColumn("symbol", F.explode(F.array(*map(F.lit, symbols))))
    w = Window.partitionBy("symbol").orderBy("dt")
    d = d.withColumn("i", F.row_number().over(w)).where(F.col("i") <= days).withColumn("lr", drift - vol * vol / 2 + vol * normal("symbol", "dt", seed=seed))
    return d.select("symbol", "dt", (100 * F.exp(F.sum("lr").over(w.rowsBetween(Window.unboundedPreceding, 0)))).alias("price"))


class _Symbol(InputPartition):
    def __init__(self, symbol: str):
        super().__init__(symbol)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.symbols = [s for s in options.get("symbols", "A").split(",") if s]
        self.days, self.seed = int(options.get("days", "252")), int(options.get("seed", "42"))

    def partitions(self):
        return [_Symbol(s) for s in self.symbols]

    def read(self, partition):
        import zlib

        import numpy as np
        import pandas as pd
        import pyarrow as pa

        rng = np.random.default_rng([self.seed, zlib.crc32(partition.value.encode())])
        dt = pd.bdate_range("2008-01-01", periods=self.days).date
        price = 100 * np.exp(np.cumsum(rng.normal(0.0003, 0.01, self.days)))
        yield pa.RecordBatch.from_arrays([pa.array([partition.value] * self.days), pa.array(dt, pa.date32()), pa.array(price)], ["symbol", "dt", "price"])


class SyntheticPrices(DataSource):
    """spark.dataSource.register(SyntheticPrices); spark.read.format("synthetic_prices").options(symbols="A,B", days=500).load()"""

    @classmethod
    def name(cls) -> str:
        return "synthetic_prices"

    def schema(self) -> str:
        return "symbol string, dt date, price double"

    def reader(self, schema):
        return _Reader(self.options)
