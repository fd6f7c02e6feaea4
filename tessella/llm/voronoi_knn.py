"""Operator 10: exact top-k search by inner product as a Voronoi kNN join.

1. A bounded sample of rows (`PIVOTS`, by a hash of vec_id) serves as pivots. Every row goes to its nearest pivot's cell.
2. Summaries, one row per cell: rows, radius (largest distance from the pivot), queries, and the queries' radius. For
   every query group G, the (k + 1) largest lower bounds p_G.c - u_G |c| over all vec_ids (the best row c of each), merged
   from partial tops, give a score that rows of k other vec_ids surely reach for every query of G.
3. A cell can hold a better row for G only if p_G.p_j + |p_G| r_j + u_G (|p_j| + r_j) reaches that score. Query groups
   are replicated to the surviving cells only. Cells are cut into chunks of about `CHUNK` rows by a hash of vec_id, so a
   cell that holds a third of all rows is many tasks.
4. Each chunk multiplies its rows by its queries and keeps each query's k best; a window merges the chunks.

Vectors become floor(256 * x); scores are exact integers (float64 products while every partial sum stays below 2**53,
int64 products beyond). Ties go to the smaller vec_id.

Edge cases: null vectors, vectors with a null, NaN or infinite component, and rows with a null vec_id take no part;
shorter vectors count as padded with zeros; rows of one vec_id are never each other's candidates; a repeated vec_id is a
candidate once per row; fewer than k candidates give fewer rows; empty tables give an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

PIVOTS = 48
CHUNK = 8192
SCALE = 256


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the rows that take part."""
    good = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    v = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(good).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    col = pa.concat_arrays(col.chunks) if isinstance(col, pa.ChunkedArray) and col.num_chunks else col
    if not len(col):
        return np.zeros((0, dim), np.int64)
    n = np.diff(col.offsets.to_numpy())
    out = np.zeros((len(col), dim), np.int64)
    out[np.arange(dim)[None, :] < n[:, None]] = col.flatten().to_numpy()
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def knn_join(rows: DataFrame, is_query, k: int = 5, pivots: int = PIVOTS, chunk: int = CHUNK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k best other rows by inner product. rows: (vec_id, v array<long>)."""
    spark = rows.sparkSession
    rows = rows.select("vec_id", "v")
    picked = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    dim = rows.agg(F.max(F.size("v"))).head()[0] or 1
    centre = np.zeros((max(1, len(picked)), dim))
    for i, r in enumerate(picked):
        centre[i, : len(r["v"])] = r["v"]
    centre_norm = np.linalg.norm(centre, axis=1)

    def assign(batches):
        for b in batches:
            m = _matrix(b.column("v"), dim).astype(np.float64)
            d2 = (m**2).sum(axis=1)[:, None] - 2 * m @ centre.T + centre_norm[None, :] ** 2
            cell = d2.argmin(axis=1)
            far = np.linalg.norm(m - centre[cell], axis=1)
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("vec_id", "v", "query")), pa.array(cell, pa.int32()), pa.array(far)], ["vec_id", "v", "query", "cell", "far"])

    dealt = c.kept(rows.withColumn("query", is_query).mapInArrow(assign, "vec_id long, v array<long>, query boolean, cell int, far double"))
    summary = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r"), F.max(F.when(F.col("query"), F.col("far"))).alias("u")).collect()
    n_cells = len(centre)
    radius, reach, size = np.zeros(n_cells), np.full(n_cells, -1.0), np.zeros(n_cells, np.int64)
    for r in summary:
        size[r["cell"]], radius[r["cell"]], reach[r["cell"]] = r["n"], r["r"], -1.0 if r["u"] is None else r["u"]
    groups = np.flatnonzero(reach >= 0)

    def lower(batches):
        ids, top = np.zeros((len(groups), 0), np.int64), np.zeros((len(groups), 0))
        for b in batches:
            m = _matrix(b.column("v"), dim).astype(np.float64)
            lb = centre[groups] @ m.T - reach[groups][:, None] * np.linalg.norm(m, axis=1)[None, :]
            new, of = np.unique(b.column("vec_id").to_numpy(), return_inverse=True)  # rows of one vec_id count once
            if len(new) < len(of):
                order = np.argsort(of, kind="stable")
                lb = np.maximum.reduceat(lb[:, order], np.searchsorted(of[order], np.arange(len(new))), axis=1)
            ids, top = np.concatenate([ids, np.broadcast_to(new, lb.shape)], axis=1), np.concatenate([top, lb], axis=1)
            order = np.lexsort((-top, ids), axis=1)
            ids, top = np.take_along_axis(ids, order, axis=1), np.take_along_axis(top, order, axis=1)
            top[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf
            order = np.argsort(-top, axis=1, kind="stable")[:, : k + 1]
            ids, top = np.take_along_axis(ids, order, axis=1), np.take_along_axis(top, order, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(groups, ids.shape[1]), pa.int32()), pa.array(ids.ravel()), pa.array(top.ravel())], ["cell", "vec_id", "lb"])

    tops = dealt.select("vec_id", "v").mapInArrow(lower, "cell int, vec_id long, lb double").groupBy("cell", "vec_id").agg(F.max("lb").alias("lb"))
    tops = tops.groupBy("cell").agg(F.get(F.sort_array(F.collect_list("lb"), False), k).alias("t")).where("t is not null").collect()
    sure = np.full(n_cells, -np.inf)
    for r in tops:
        sure[r["cell"]] = r["t"]
    above = centre @ centre.T + centre_norm[:, None] * radius[None, :] + np.maximum(reach, 0)[:, None] * (centre_norm + radius)[None, :]
    # rounding errors grow with the lengths of the vectors, not with the bounds, which may be negative or cancel
    slack = 1e-9 * (centre_norm + np.maximum(reach, 0)) * (centre_norm + radius).max() + 1e-6
    parts = np.maximum(1, -(-size // chunk))
    visit = [(int(g), int(j), int(parts[j])) for g in groups for j in np.flatnonzero(size) if above[g, j] + slack[g] >= sure[g]]
    # at most PIVOTS * PIVOTS rows, whatever the input
    visits = spark.createDataFrame(visit, "cell int, to int, parts int")
    part_of = spark.createDataFrame([(int(j), int(parts[j])) for j in np.flatnonzero(size)], "cell int, parts int")
    queries = dealt.where("query").join(F.broadcast(visits), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(F.col("to").alias("q_cell"), F.col("part").alias("q_part"), F.col("vec_id").alias("q_id"), F.col("v").alias("q"))
    data = dealt.join(F.broadcast(part_of), "cell").select("cell", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int").alias("part"), "vec_id", "v")

    def solve(key, queries, data):
        q_id, d_id = queries.column("q_id").to_numpy(), data.column("vec_id").to_numpy()
        out = [], [], []
        if len(q_id) and len(d_id):
            q, d = _matrix(queries.column("q"), dim), _matrix(data.column("v"), dim)
            for a in range(0, len(q_id), 256):
                score = _products(q[a : a + 256], d)
                for i, s in enumerate(score):
                    own = d_id != q_id[a + i]
                    ids, s = d_id[own], s[own]
                    if len(s) > k:
                        best = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k])
                        ids, s = ids[best], s[best]
                    best = np.lexsort((ids, -s))[:k]
                    for o, x in zip(out, (np.full(len(best), q_id[a + i]), ids[best], s[best])):
                        o.append(x)
        cat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.table({"query_id": cat(out[0]), "vec_id": cat(out[1]), "score": cat(out[2])})

    local = queries.groupBy("q_cell", "q_part").cogroup(data.groupBy("cell", "part")).applyInArrow(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
