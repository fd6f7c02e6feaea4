"""Rank correlation in every sliding window: each bar is ranked anew in each window that holds it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .panel import along

CELLS = 1 << 23


def _ranks(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Average ranks of every row's good cells, by counting the good cells below and beside each."""
    a, b = x[:, :, None], x[:, None, :]
    both = good[:, None, :]
    return ((b < a) & both).sum(2) + (((b == a) & both).sum(2) + 1) / 2


def window_correlations(x: np.ndarray, y: np.ndarray, window: int) -> np.ndarray:
    """For every end from window - 1 on: the correlation of average ranks of the finite pairs, 0 where under five or all equal."""
    xs, ys = (np.lib.stride_tricks.sliding_window_view(v, window) for v in (x, y))
    out = np.empty(len(xs))
    step = max(1, CELLS // (window * window))
    for i in range(0, len(xs), step):
        a, b = xs[i : i + step], ys[i : i + step]
        good = np.isfinite(a) & np.isfinite(b)
        n = np.maximum(good.sum(1), 1)[:, None]
        ra, rb = (np.where(good, _ranks(v, good), 0.0) for v in (a, b))
        da, db = (np.where(good, r - r.sum(1, keepdims=True) / n, 0.0) for r in (ra, rb))
        below = np.sqrt((da * da).sum(1) * (db * db).sum(1))
        out[i : i + step] = np.where((n[:, 0] >= 5) & (below > 0), (da * db).sum(1) / np.where(below > 0, below, 1), 0.0)
    return out


def rolling_rank_ic(df: DataFrame, key: str, x: str, y: str, window: int = 60, block: int = 4096, order: str = "dt") -> DataFrame:
    """(key, order, ic): the rank correlation of x and y over the `window` rows that end there.

    A key's rows are dealt to blocks of `block` rows; the window - 1 rows before a block go to it as well. Rows whose x or y is
    null or not finite stay in their windows and are left out of the ranks. Keys of under `window` rows give none.
    """
    d = df.select(key, order, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).withColumn("i", (F.row_number().over(along(key, order)) - 1).cast("long"))
    d = d.withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / block), F.floor((F.col("i") + window - 1) / block))))

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        i = table.column("i").to_numpy()
        first = max(int(table.column("block")[0].as_py()) * block, window - 1)
        at = np.flatnonzero((i >= first) & (i < (int(table.column("block")[0].as_py()) + 1) * block))
        lo = int(at[0]) - window + 1 if len(at) else 0
        values = [table.column(c).to_numpy(zero_copy_only=False)[lo:].astype(float) for c in ("x", "y")]
        ic = window_correlations(*values, window) if len(at) else np.zeros(0)
        out = table.select([key, order]).slice(int(at[0]) if len(at) else 0, len(at))
        return out.append_column("ic", pa.array(ic, pa.float64()))

    schema = f"{key} {df.schema[key].dataType.simpleString()}, {order} {df.schema[order].dataType.simpleString()}, ic double"
    return d.groupBy(key, "block").applyInArrow(one, schema)


def ic_ratio(ic: DataFrame, key: str) -> DataFrame:
    """(key, windows, ic_mean, ic_std, ic_ir): the ratio is 0 where the deviation is 0 or there is one window."""
    d = ic.groupBy(key).agg(F.count("ic").alias("windows"), F.avg("ic").alias("ic_mean"), F.coalesce(F.stddev_samp("ic"), F.lit(0.0)).alias("ic_std"))
    return d.withColumn("ic_ir", F.coalesce(F.try_divide("ic_mean", "ic_std"), F.lit(0.0)))
