"""Queries: books searched over low-discrepancy weights, and the greedy chain of names."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tessella.functions import stats
from tessella.operators import book_search

from .inference import cdf, ppf
from .registry import query

_NAMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_POINTS, _TOP, _K = 256, 10, range(5)


def _coordinate(dim: int) -> str:
    out = "0"
    for k, v in enumerate(book_search.directions(dim)[:8]):
        out = f"xor({out}, CASE WHEN (n >> {k}) & 1 = 1 THEN {v} ELSE 0 END)"
    return f"(-ln(1 - {out} / 1073741824.0e0 * (1 - 1e-9)) + 1e-12)"


_LIST = ", ".join(f"w{k}" for k in _K)
_WIDE = f"""wide AS (SELECT *, row_number() OVER (ORDER BY dt) - 1 AS i, count(*) OVER () AS n FROM (SELECT dt, {", ".join(f"max(ret) FILTER (symbol = '{x}') AS r{k}" for k, x in enumerate(_NAMES))} FROM pr WHERE ret IS NOT NULL GROUP BY dt HAVING count(*) = 5))"""
_BEST = f"""WITH e AS (SELECT n, {", ".join(f"{_coordinate(k)} AS e{k}" for k in _K)} FROM (SELECT unnest(range({_POINTS})) AS n)),
    samples AS (SELECT min(n) AS sample, {_LIST} FROM (SELECT n, {", ".join(f"round(e{k} / (e0 + e1 + e2 + e3 + e4), 4) AS w{k}" for k in _K)} FROM e) GROUP BY {_LIST}),
    {_WIDE},
    series AS (SELECT sample, dt, CAST(ceil((i + 1) * 10 / n) - 1 AS INT) AS g, {" + ".join(f"w{k} * r{k}" for k in _K)} AS r FROM wide CROSS JOIN samples),
    parts AS (SELECT sample, g, CAST(count(*) AS DOUBLE) AS n, sum(r) AS s, sum(r * r) AS q FROM series GROUP BY 1, 2),
    paths AS (SELECT sample, s / n / sqrt((q - s * s / n) / (n - 1)) * sqrt(252) AS x FROM (SELECT a.sample, a.n + b.n AS n, a.s + b.s AS s, a.q + b.q AS q FROM parts AS a JOIN parts AS b ON a.sample = b.sample AND a.g < b.g)),
    scores AS (SELECT sample, avg(x) AS oos_mean, stddev_pop(x) AS oos_std, avg(x) / (1 + stddev_pop(x)) AS stability FROM paths GROUP BY 1),
    leaders AS (SELECT *, count(*) OVER () AS books FROM scores QUALIFY row_number() OVER (ORDER BY round(stability, 12) DESC, sample) <= {3 * _TOP}),
    led AS (SELECT series.*, sum(ln(1 + r)) OVER (PARTITION BY sample ORDER BY dt) AS le FROM series SEMI JOIN leaders USING (sample)),
    whole AS (SELECT sample, count(*) AS n, avg(r) / stddev_samp(r) AS per, (avg(r*r*r) - 3*avg(r)*avg(r*r) + 2*pow(avg(r),3)) / pow(var_pop(r), 1.5) AS sk, kurtosis_pop(r) AS ku, exp(sum(ln(1 + r)) * 252 / count(*)) - 1 AS cagr FROM led GROUP BY 1),
    dd AS (SELECT sample, min(exp(le - top) - 1) AS max_drawdown FROM (SELECT sample, le, max(le) OVER (PARTITION BY sample ORDER BY dt) AS top FROM led) GROUP BY 1),
    months AS (SELECT sample, avg(CAST(c > 0 AS DOUBLE)) AS positive_months FROM (SELECT sample, sum(ln(1 + r)) AS c FROM led GROUP BY sample, date_trunc('month', dt)) GROUP BY 1),
    years AS (SELECT sample, avg(CAST(c > 0 AS DOUBLE)) AS positive_years FROM (SELECT sample, sum(ln(1 + r)) AS c FROM led GROUP BY sample, year(dt)) GROUP BY 1),
    d AS (SELECT *, per * sqrt(252) AS sharpe, sk * sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2) AS g1, ((n + 1) * ku + 6) * (n - 1) / (CAST(n - 2 AS DOUBLE) * (n - 3)) AS g2, CAST(books AS DOUBLE) AS trials FROM leaders JOIN whole USING (sample) JOIN dd USING (sample) JOIN months USING (sample) JOIN years USING (sample)),
    z AS (SELECT *, (per - ((1 - {stats.EULER!r}) * {ppf("(1 - 1 / trials)")} + {stats.EULER!r} * {ppf(f"(1 - 1 / (trials * {math.e!r}))")}) / sqrt(n - 1)) / sqrt((1 + 0.5 * per * per - g1 * per + g2 / 4 * per * per) / (n - 1)) AS z FROM d),
    f AS (SELECT *, {cdf('z')} AS dsr, stability * greatest({cdf('z')}, 0.3) * greatest(positive_months, 1e-6) * greatest(positive_years, 1e-6) AS composite FROM z)
    SELECT f.*, {_LIST}, row_number() OVER (ORDER BY round(composite, 12) DESC, sample) AS place FROM f JOIN samples USING (sample) QUALIFY place <= {_TOP}"""


def _book(v):
    return v.pr.where("ret is not null").select(F.lit("all").alias("family"), F.col("symbol").alias("run_id"), "dt", F.col("ret").alias("r"))


@query("", "place sample n", "w0 w1 w2 w3 w4 composite stability dsr positive_months positive_years sharpe oos_mean oos_std cagr max_drawdown", _BEST, "px pr", places=6)
def best_books(v):
    samples = book_search.simplex(book_search.sobol(v.spark, _POINTS, 5))
    out = book_search.best_books(_book(v), samples, "family", _TOP)
    return out.select("*", *[F.col("w")[k].alias(f"w{k}") for k in _K])


def _greedy(steps: int) -> str:
    out = f"WITH {_WIDE}, names AS (SELECT unnest({list(_K)}) AS p), s0 AS (SELECT CAST(0 AS BIGINT) AS mask)"
    column = "CASE p " + " ".join(f"WHEN {k} THEN r{k}" for k in _K) + " END"
    taken = " + ".join(f"CASE WHEN (mask >> {k}) & 1 = 1 THEN r{k} ELSE 0 END" for k in _K)
    for k in range(1, steps + 1):
        out += f""", t{k} AS (SELECT p, mask, avg(b) / stddev_samp(b) * sqrt(252) AS sharpe FROM (SELECT p, mask, ({taken} + {column}) / {k} AS b FROM wide CROSS JOIN names CROSS JOIN s{k - 1} WHERE (mask >> p) & 1 = 0) GROUP BY 1, 2),
        b{k} AS (SELECT {k} AS place, p, mask, sharpe FROM t{k} ORDER BY round(sharpe, 12) DESC, p LIMIT 1), s{k} AS (SELECT mask + (CAST(1 AS BIGINT) << p) AS mask FROM b{k})"""
    every = " UNION ALL ".join(f"SELECT place, p, sharpe FROM b{k}" for k in range(1, steps + 1))
    return out + f" SELECT place, CASE p {' '.join(f'WHEN {k} THEN {x!r}' for k, x in enumerate(_NAMES))} END AS run_id, sharpe FROM ({every})"


@query("run_id", "place", "sharpe", _greedy(4), "px pr", places=6)
def greedy_chain(v):
    return book_search.greedy_chain(_book(v), "family", 4)
