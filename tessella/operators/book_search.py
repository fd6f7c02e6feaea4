"""Search for books: low-discrepancy weights, cross-validated scores from moments, a composite rank, and a greedy chain.

A book's return in a group of dates has mean w's and square w'Qw, with s the names' sums there and Q the sums of their products.
So the dates are read once, into one small matrix a group; thousands of books are then scored without a date, in blocks of
books. Only the leaders' returns are built, for what moments do not tell. `family` keys everything; a family's names are few
enough for its matrices to be a row (some hundreds).
"""

from __future__ import annotations

import itertools
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.functions import metrics as m
from tessella.functions import stats

from .panel import along
from .simulate import core_metrics
from .validation import sharpe_se

#: Primitive polynomials (degree, inner coefficients) and first direction numbers of Sobol's sequence, dimensions 2 on.
SOBOL = [
    (1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3)), (4, 4, (1, 3, 5, 13)), (5, 2, (1, 1, 5, 5, 17)),
    (5, 4, (1, 1, 5, 5, 5)), (5, 7, (1, 1, 7, 11, 19)), (5, 11, (1, 1, 5, 1, 1)), (5, 13, (1, 1, 1, 3, 11)), (5, 14, (1, 3, 5, 5, 31)),
]
BITS = 30
GROUPS, TEST, LEAST = 10, 2, 20


def directions(dim: int, bits: int = BITS) -> list[int]:
    """The numbers, of `bits` bits, whose exclusive ors are the coordinates of dimension `dim` (from 0)."""
    if dim == 0:
        return [1 << (bits - 1 - k) for k in range(bits)]
    degree, inner, first = SOBOL[dim - 1]
    odd = list(first)
    for k in range(degree, bits):
        x = odd[k - degree] ^ (odd[k - degree] << degree)
        for j in range(1, degree):
            if inner >> (degree - 1 - j) & 1:
                x ^= odd[k - j] << j
        odd.append(x)
    return [x << (bits - 1 - k) for k, x in enumerate(odd[:bits])]


def sobol(spark: SparkSession, points: int, dims: int) -> DataFrame:
    """(point, u): the first points of Sobol's sequence, u an array of `dims` numbers in [0, 1), as column expressions of `range`."""
    if dims > len(SOBOL) + 1:
        raise ValueError(f"directions are known for {len(SOBOL) + 1} dimensions")
    bits = max(1, (points - 1).bit_length())

    def coordinate(dim: int) -> Column:
        on = [F.when(F.shiftright("id", k).bitwiseAND(1) == 1, v).otherwise(0) for k, v in enumerate(directions(dim)[:bits])]
        return reduce(lambda a, b: a.bitwiseXOR(b), on) / F.lit(float(1 << BITS))

    return spark.range(points).select(F.col("id").alias("point"), F.array(*[coordinate(d) for d in range(dims)]).alias("u"))


def simplex(points: DataFrame) -> DataFrame:
    """(sample, w): points of the cube as weights that are evenly spread over the simplex, to four places; equal ones once."""
    e = F.transform("u", lambda u: -F.log1p(-u * (1 - 1e-9)) + 1e-12)
    d = points.select("point", e.alias("e")).withColumn("sum", F.aggregate("e", F.lit(0.0), lambda a, x: a + x))
    return d.select("point", F.transform("e", lambda x: F.round(x / F.col("sum"), 4)).alias("w")).groupBy("w").agg(F.min("point").alias("sample")).select("sample", "w")


def dated(returns: DataFrame, family: str, name: str) -> DataFrame:
    """(family, dt, i, n, r): the names' returns, in order of their names, on the dates that have them all."""
    size = returns.groupBy(family).agg(F.count_distinct(name).alias("names"))
    d = returns.where("r is not null").groupBy(family, "dt").agg(F.array_sort(F.collect_list(F.struct(name, "r"))).alias("x")).join(size, family).where(F.size("x") == F.col("names"))
    return d.select(family, "dt", F.transform("x", lambda s: s["r"]).alias("r"), (F.row_number().over(along(family)) - 1).cast("long").alias("i"), F.count("*").over(Window.partitionBy(family)).alias("n"))


def moments(rows: DataFrame, family: str, groups: int) -> DataFrame:
    """(family, moments): of every group of dates its number, their sums and the sums of their products, as one array."""

    def one(table: pa.Table) -> pa.Table:
        r = table.column("r").combine_chunks()
        x = r.flatten().to_numpy().reshape(len(r), -1)
        out = table.select([family, "g"]).slice(0, 1)
        return out.append_column("n", pa.array([len(x)])).append_column("s", pa.array([x.sum(0).tolist()])).append_column("q", pa.array([(x.T @ x).ravel().tolist()]))

    g = (F.ceil((F.col("i") + 1) * groups / F.col("n")) - 1).cast("int")
    t = rows.schema[family].dataType.simpleString()
    d = rows.withColumn("g", g).groupBy(family, "g").applyInArrow(one, f"{family} {t}, g int, n long, s array<double>, q array<double>")
    return d.groupBy(family).agg(F.array_sort(F.collect_list(F.struct("g", "n", "s", "q"))).alias("moments"))


def book_scores(returns: DataFrame, samples: DataFrame, family: str, name: str = "run_id", groups: int = GROUPS, test: int = TEST, ppy: int = m.PPY) -> DataFrame:
    """(family, sample, n, sharpe, oos_mean, oos_std, stability): books on the dates that all names of the family share.

    samples: sample, w (weights in the order of the names; those of another length are left out). The out-of-sample Sharpes are those
    of all choices of `test` of `groups` groups; stability is their mean over one plus their deviation. Under LEAST dates a
    group there is one path, all dates.
    """
    held = moments(dated(returns, family, name), family, groups)
    paths = list(itertools.combinations(range(groups), test))

    def score(batches):
        for b in batches:
            fam, w_all = b.column(family), b.column("w")
            rows = {x: np.empty(len(fam)) for x in ("n", "sharpe", "oos_mean", "oos_std")}
            keys = fam.dictionary_encode()
            code = keys.indices.to_numpy()
            for f in range(len(keys.dictionary)):
                at = np.flatnonzero(code == f)
                parts = b.column("moments")[int(at[0])].as_py()
                w = w_all.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                n = np.array([p["n"] for p in parts], float)
                s = np.stack([w @ np.array(p["s"]) for p in parts])
                q = np.stack([((w @ np.array(p["q"]).reshape(w.shape[1], -1)) * w).sum(1) for p in parts])

                def sharpe(pick):
                    k, a, c = n[pick].sum(), s[pick].sum(0), q[pick].sum(0)
                    sd = np.sqrt(np.maximum(c - a * a / k, 0) / max(k - 1, 1))
                    return np.where(sd > 1e-12, a / k / np.where(sd > 1e-12, sd, 1) * math.sqrt(ppy), 0.0)

                everything = sharpe(list(range(len(parts))))
                oos = np.stack([sharpe(list(p)) for p in paths]) if len(parts) == groups and n.sum() >= groups * LEAST else everything[None]
                rows["n"][at], rows["sharpe"][at], rows["oos_mean"][at], rows["oos_std"][at] = n.sum(), everything, oos.mean(0), oos.std(0)
            yield pa.RecordBatch.from_arrays([fam, b.column("sample"), pa.array(rows["n"].astype(np.int64)), *[pa.array(rows[x]) for x in ("sharpe", "oos_mean", "oos_std")]], [family, "sample", "n", "sharpe", "oos_mean", "oos_std"])

    d = held.crossJoin(samples) if family not in samples.columns else held.join(samples, family)  # every book of every family is the result
    d = d.where(F.size("w") == F.size(F.col("moments")[0]["s"])).select(family, "sample", "w", "moments")
    t = returns.schema[family].dataType.simpleString()
    out = d.mapInArrow(score, f"{family} {t}, sample {samples.schema['sample'].dataType.simpleString()}, n long, sharpe double, oos_mean double, oos_std double")
    return out.withColumn("stability", F.col("oos_mean") / (1 + F.col("oos_std")))


def best_books(returns: DataFrame, samples: DataFrame, family: str, top: int = 50, name: str = "run_id", ppy: int = m.PPY) -> DataFrame:
    """(family, place, sample, w, composite, stability, dsr, positive_months, positive_years, n, sharpe, oos_mean, oos_std, cagr,
    max_drawdown): the books of greatest composite among the 3 * top most stable ones.

    composite = stability * max(dsr, 0.3) * share of positive months * share of positive years; dsr is deflated by the number of
    books of the family and takes the unbiased skewness and kurtosis. Ties go to the smaller sample.
    """
    scores = book_scores(returns, samples, family, name, ppy=ppy)
    by = Window.partitionBy(family)
    scores = scores.withColumn("books", F.count("*").over(by)).withColumn("k", F.row_number().over(by.orderBy(F.desc(F.round("stability", 12)), "sample")))
    weights = [family, "sample"] if family in samples.columns else ["sample"]
    leaders = scores.where(F.col("k") <= 3 * top).join(samples, weights)
    earned = F.aggregate(F.zip_with("w", "r", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    series = leaders.select(family, "sample", "w").join(dated(returns, family, name), family).select(family, "sample", "dt", earned.alias("r"))
    whole = core_metrics(series, (family, "sample"), ppy).select(family, "sample", "cagr", "max_drawdown", F.col("skewness").alias("g"), F.col("kurtosis").alias("h"))

    def positive(unit: str, out: str) -> DataFrame:
        d = series.groupBy(family, "sample", F.trunc("dt", unit).alias("p")).agg(F.sum(F.log1p("r")).alias("c"))
        return d.groupBy(family, "sample").agg(F.avg((F.col("c") > 0).cast("double")).alias(out))

    d = leaders.join(whole, [family, "sample"]).join(positive("MM", "positive_months"), [family, "sample"]).join(positive("YYYY", "positive_years"), [family, "sample"])
    n, per = F.col("n").cast("double"), F.col("sharpe") / math.sqrt(ppy)
    skew = F.when(n > 2, F.col("g") * F.sqrt(n * (n - 1)) / (n - 2)).otherwise(0.0)
    kurt = F.when(n > 3, ((n + 1) * F.col("h") + 6) * (n - 1) / ((n - 2) * (n - 3))).otherwise(0.0)
    k = F.col("books").cast("double")
    most = F.when(k > 1, ((1 - stats.EULER) * stats.norm_ppf(1 - 1 / k) + stats.EULER * stats.norm_ppf(1 - 1 / (k * math.e))) / F.sqrt(n - 1)).otherwise(0.0)
    se = sharpe_se(per, n, skew, kurt)
    d = d.withColumn("dsr", F.when((se > 0) & (se < float("inf")), stats.norm_cdf((per - most) / se)).otherwise(0.5))
    steady = F.greatest("positive_months", F.lit(1e-6)) * F.greatest("positive_years", F.lit(1e-6))
    d = d.withColumn("composite", F.col("stability") * F.greatest("dsr", F.lit(0.3)) * steady)
    d = d.withColumn("place", F.row_number().over(by.orderBy(F.desc(F.round("composite", 12)), "sample"))).where(F.col("place") <= top)
    return d.select(family, "place", "sample", "w", "composite", "stability", "dsr", "positive_months", "positive_years", "n", "sharpe", "oos_mean", "oos_std", "cagr", "max_drawdown")


def greedy_chain(returns: DataFrame, family: str, most: int, name: str = "run_id", ppy: int = m.PPY) -> DataFrame:
    """(family, place, name, sharpe): names in the order in which each next one gives the equal-weight book of all so far the
    greatest Sharpe (ties to the smaller name), `most` of them at the most, and that Sharpe.

    One row a name, which holds its sum and its products with all names; a step updates the rows from the name that was taken.
    """
    rows = dated(returns, family, name)
    names = returns.groupBy(family).agg(F.array_sort(F.collect_set(name)).alias("names"))
    whole = moments(rows, family, 1).join(names, family).select(family, "names", F.col("moments")[0].alias("x"))
    d = whole.select(family, F.posexplode("names").alias("p", name), F.col("x.n").alias("n"), F.col("x.s").alias("s"), F.col("x.q").alias("q"))
    k = F.size("s")
    d = d.select(family, name, "p", "n", F.get("s", F.col("p")).alias("own"), F.slice("q", F.col("p") * k + 1, k).alias("row"))
    of = Window.partitionBy(family)
    d = d.select("*", F.lit(0.0).alias("sum"), F.lit(0.0).alias("square"), F.lit(0.0).alias("cross"), F.lit(None).cast("int").alias("place"), F.lit(None).cast("double").alias("sharpe"))
    for step in range(1, most + 1):
        total, square = F.col("sum") + F.col("own"), F.col("square") + 2 * F.col("cross") + F.get("row", F.col("p"))
        mean = total / step / F.col("n")
        sd = F.sqrt(F.greatest(square / step**2 - F.col("n") * mean * mean, F.lit(0.0)) / F.greatest(F.col("n") - 1, F.lit(1)))
        s = F.when(sd > 1e-12, mean / sd * math.sqrt(ppy)).otherwise(0.0)
        best = F.max(F.when(F.col("place").isNull(), F.struct(F.round(s, 12).alias("r"), (-F.col("p")).alias("neg"), s.alias("s"), total.alias("sum"), square.alias("square")))).over(of)
        d = d.withColumn("best", best)
        taken = F.col("p") == -F.col("best.neg")
        d = d.withColumns({
            "place": F.when(taken, step).otherwise(F.col("place")), "sharpe": F.when(taken, F.col("best.s")).otherwise(F.col("sharpe")),
            "sum": F.coalesce("best.sum", "sum"), "square": F.coalesce("best.square", "square"), "cross": F.col("cross") + F.coalesce(F.get("row", -F.col("best.neg")), F.lit(0.0)),
        })
    return d.where("place is not null").select(family, "place", name, "sharpe")
