"""Queries: statistical tests, tails, overfit statistics, verdict, signal quality, attribution."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessella.functions import stats
from tessella.operators import diagnosis, inference, panel, simulate, validation

from .registry import query


def _poly(down, x):
    out = f"{down[0]:.17e}"
    for k in down[1:]:
        out = f"({out}) * {x} + {k:.17e}"
    return f"({out})"


def cdf(x: str) -> str:
    """The normal distribution function in DuckDB's SQL; tests hold the column expression against math.erfc."""
    a = f"abs({x})"
    tail = f"CASE WHEN {a} < 7.07106781186547 THEN exp(-{a} * {a} / 2) * {_poly(stats._CDF_TOP, a)} / {_poly(stats._CDF_BOTTOM, a)} ELSE 0 END"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


def ppf(p: str) -> str:
    part = lambda k, x: f"{_poly(stats._PPF[k][0][::-1], x)} / {_poly(stats._PPF[k][1][::-1], x)}"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"(CASE WHEN {p} <= 0 OR {p} >= 1 THEN NULL WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {part(0, f'(0.180625 - ({p} - 0.5) * ({p} - 0.5))')} ELSE sign({p} - 0.5) * CASE WHEN {r} <= 5 THEN {part(1, f'({r} - 1.6)')} ELSE {part(2, f'({r} - 5)')} END END)"


def chi2(x: str, k: int) -> str:
    out = f"2 * {cdf(f'(-sqrt({x}))')}" if k % 2 else f"exp(-{x} / 2)"
    for j in range(k % 2 or 2, k, 2):
        out += f" + pow({x} / 2, {j / 2!r}) * exp(-{x} / 2) / {math.gamma(j / 2 + 1):.17e}"
    return f"(CASE WHEN {x} <= 0 THEN 1 ELSE {out} END)"


_MOMENTS = "count(r) AS n, avg(r) AS mu, stddev_samp(r) AS sd, (avg(r*r*r) - 3*avg(r)*avg(r*r) + 2*pow(avg(r),3)) / pow(var_pop(r), 1.5) AS skew, kurtosis_pop(r) AS kurt"


@query("run_id is_normal", "n", "statistic p_value", f"SELECT *, p_value > 0.05 AS is_normal FROM (SELECT *, {chi2('statistic', 2)} AS p_value FROM (SELECT run_id, n, n / 6.0 * (skew * skew + kurt * kurt / 4) AS statistic FROM (SELECT run_id, {_MOMENTS} FROM rets GROUP BY 1)))", "rets", places=6)
def jarque_bera(v):
    return inference.jarque_bera(v.rets)


@query("run_id", "runs", "z p_value", f"""SELECT run_id, runs, z, 2 * {cdf('(-abs(z))')} AS p_value FROM (SELECT run_id, runs, (runs - 1 - 2.0 * a * b / (a + b)) / sqrt(2.0 * a * b * (2.0 * a * b - a - b) / ((a + b) * (a + b) * (a + b - 1.0))) AS z FROM (
    SELECT run_id, 1 + sum(CAST(up <> p AS INT)) AS runs, CAST(count(*) FILTER (up) AS DOUBLE) AS a, CAST(count(*) FILTER (NOT up) AS DOUBLE) AS b FROM (SELECT run_id, up, lag(up) OVER (PARTITION BY run_id ORDER BY dt) AS p FROM (
    SELECT run_id, dt, r > mid AS up FROM rets JOIN (SELECT run_id, median(r) AS mid FROM rets GROUP BY 1) USING (run_id))) GROUP BY 1))""", "rets", places=6)  # fmt: skip
def runs_test(v):
    return inference.runs_test(v.rets)


@query("run_id reading", "q", "vr z p_value", f"""SELECT *, 2 * {cdf('(-abs(z))')} AS p_value, CASE WHEN vr > 1.2 THEN 'trending' WHEN vr < 0.8 THEN 'mean_reverting' ELSE 'random_walk' END AS reading FROM (
    SELECT run_id, q, vr, (vr - 1) / sqrt(2.0 * (2 * q - 1) * (q - 1) / (3.0 * q * n)) AS z FROM (SELECT run_id, q, any_value(n) AS n, sum(pow(rq - q * mu, 2)) / (q * (any_value(n) - q + 1) * (1 - q / CAST(any_value(n) AS DOUBLE))) / any_value(v) AS vr FROM (
    SELECT run_id, q, s - coalesce(max(s) OVER (PARTITION BY run_id, q ORDER BY i RANGE BETWEEN q PRECEDING AND q PRECEDING), 0) AS rq, i FROM (SELECT run_id, sum(r) OVER (PARTITION BY run_id ORDER BY dt) AS s, row_number() OVER (PARTITION BY run_id ORDER BY dt) AS i FROM rets) CROSS JOIN (SELECT 2 AS q UNION ALL SELECT 5 UNION ALL SELECT 10))
    JOIN (SELECT run_id, count(*) AS n, avg(r) AS mu, var_samp(r) AS v FROM rets GROUP BY 1) USING (run_id) WHERE i >= q GROUP BY 1, 2))""", "rets", places=6)  # fmt: skip
def variance_ratio(v):
    return inference.variance_ratio(v.rets, [2, 5, 10])


@query("run_id", "n", "statistic p_value", f"""SELECT *, {chi2('statistic', 10)} AS p_value FROM (SELECT run_id, any_value(n) AS n, any_value(n) * (any_value(n) + 2) * sum(pow(c / c0, 2) / (n - k)) AS statistic FROM (
    SELECT a.run_id, b.i - a.i AS k, sum(a.d * b.d) AS c FROM d AS a JOIN d AS b ON a.run_id = b.run_id AND b.i - a.i BETWEEN 1 AND 10 GROUP BY 1, 2) JOIN (SELECT run_id, CAST(count(*) AS DOUBLE) AS n, sum(d * d) AS c0 FROM d GROUP BY 1) USING (run_id) GROUP BY 1)""".replace(
    " d AS ", " (SELECT run_id, r - avg(r) OVER (PARTITION BY run_id) AS d, row_number() OVER (PARTITION BY run_id ORDER BY dt) AS i FROM rets) AS ").replace("FROM d GROUP", "FROM (SELECT run_id, r - avg(r) OVER (PARTITION BY run_id) AS d FROM rets) GROUP"), "rets", places=6)
def ljung_box(v):
    return inference.ljung_box(v.rets)


@query("run_id verdict", "n breaches", "lr_pof lr_ind lr_cc p_pof p_ind p_cc", f"""SELECT *, CASE WHEN p_cc >= 0.05 THEN 'PASS' WHEN p_pof < 0.05 AND p_ind < 0.05 THEN 'FAIL_RATE_AND_CLUSTERING' WHEN p_pof < 0.05 THEN 'FAIL_RATE' ELSE 'FAIL_CLUSTERING' END AS verdict FROM (
    SELECT *, {chi2('lr_pof', 1)} AS p_pof, {chi2('lr_ind', 1)} AS p_ind, {chi2('lr_cc', 2)} AS p_cc FROM (SELECT *, lr_pof + lr_ind AS lr_cc FROM (
    SELECT run_id, n, x AS breaches, greatest(-2 * (x * ln(0.05) + (n - x) * ln(0.95) - x * ln(x / n) - (n - x) * ln(1 - x / n)), 0) AS lr_pof,
      greatest(-2 * ((n00 + n10) * ln(1 - (n01 + n11) / m) + (n01 + n11) * ln((n01 + n11) / m) - n00 * ln(n00 / (n00 + n01)) - n01 * ln(n01 / (n00 + n01))
        - CASE WHEN n10 > 0 THEN n10 * ln(n10 / (n10 + n11)) ELSE 0 END - CASE WHEN n11 > 0 THEN n11 * ln(n11 / (n10 + n11)) ELSE 0 END), 0) AS lr_ind FROM (
    SELECT run_id, CAST(count(*) AS DOUBLE) AS n, CAST(sum(b) AS DOUBLE) AS x, CAST(count(p) AS DOUBLE) AS m, CAST(count(*) FILTER (p = 0 AND b = 0) AS DOUBLE) AS n00, CAST(count(*) FILTER (p = 0 AND b = 1) AS DOUBLE) AS n01, CAST(count(*) FILTER (p = 1 AND b = 0) AS DOUBLE) AS n10, CAST(count(*) FILTER (p = 1 AND b = 1) AS DOUBLE) AS n11
    FROM (SELECT run_id, b, lag(b) OVER (PARTITION BY run_id ORDER BY dt) AS p FROM (SELECT run_id, dt, CAST(r < q AS INT) AS b FROM rets JOIN (SELECT run_id, quantile_cont(r, 0.05) AS q FROM rets GROUP BY 1) USING (run_id))) GROUP BY 1))))""", "rets", places=6)  # fmt: skip
def var_backtest(v):
    return inference.var_backtest(v.rets)


@query("run_id fat_tailed", "k", "hill pickands moment", """SELECT run_id, k, m1 AS hill, ln((x1 - x2) / (x2 - x4)) / ln(2.0) AS pickands, CASE WHEN m2 > m1 * m1 THEN m1 + 1 - 0.5 / (1 - m1 * m1 / m2) ELSE m1 END AS moment, 1 / m1 < 4 AS fat_tailed FROM (
    SELECT run_id, k, avg(ln(x / xk)) FILTER (rk <= k) AS m1, avg(pow(ln(x / xk), 2)) FILTER (rk <= k) AS m2, max(x) FILTER (rk = kp) AS x1, max(x) FILTER (rk = 2 * kp) AS x2, max(x) FILTER (rk = 4 * kp) AS x4 FROM (
    SELECT *, max(CASE WHEN rk = k THEN x END) OVER (PARTITION BY run_id) AS xk, CASE WHEN 4 * k > n THEN n // 4 ELSE k END AS kp FROM (SELECT *, CAST(floor(sqrt(n)) AS BIGINT) AS k FROM (
    SELECT run_id, -r AS x, row_number() OVER (PARTITION BY run_id ORDER BY r) AS rk, count(*) OVER (PARTITION BY run_id) AS n FROM rets WHERE r < 0) WHERE n >= 20)) GROUP BY run_id, k)""", "rets", places=6)  # fmt: skip
def tail_index(v):
    return inference.tail_index(v.rets)


def _over(trials: int) -> str:
    normal = (1 - stats.EULER) * float(stats.phi_inv(1 - 1 / trials)) + stats.EULER * float(stats.phi_inv(1 - 1 / (trials * math.e)))
    return f"""SELECT *, CASE WHEN p_adjusted >= 1 THEN 0 WHEN p_adjusted <= 0 THEN sr ELSE least(-z_adj * se, sr) END AS haircut_sharpe, greatest(CASE WHEN sr <> 0 THEN 1 - CASE WHEN p_adjusted >= 1 THEN 0 WHEN p_adjusted <= 0 THEN sr ELSE least(-z_adj * se, sr) END / sr ELSE 0 END, 0) AS haircut_pct FROM (SELECT *, {ppf('half_p')} AS z_adj FROM (SELECT *, p_adjusted / 2 AS half_p FROM (
    SELECT *, {cdf('z0')} AS psr, {cdf('z1')} AS dsr, least(2 * {cdf('(-abs(z0))')} * {sum(1 / k for k in range(1, trials + 1)) * trials!r}, 1) AS p_adjusted FROM (
    SELECT *, sr / se AS z0, (sr - expected_max) / se AS z1, sr * sqrt(n - 1) / sqrt(se2) AS harvey_t, CASE WHEN sr > 0 THEN greatest(se2 * pow(1.6448536269514722 / sr, 2), 1) END AS mtrl FROM (
    SELECT *, sqrt(greatest(se2, 0) / (n - 1)) AS se, {normal!r} / sqrt(n - 1) AS expected_max FROM (
    SELECT run_id, n, mu / sd AS sr, 1 + 0.5 * pow(mu / sd, 2) - skew * mu / sd + kurt / 4 * pow(mu / sd, 2) AS se2 FROM (SELECT run_id, {_MOMENTS} FROM rets GROUP BY 1))))))) """


_OVER = _over(25)


@query("run_id", "n", "sr psr dsr expected_max haircut_sharpe haircut_pct p_adjusted harvey_t mtrl", _OVER, "rets", places=6)
def overfit_stats(v):
    return validation.overfit_stats(v.rets, 25)


#: the block length from autocorrelations up to fifty lags (as for all runs of 150 to 10,000 bars), then the resamples bar by bar
_BOOT = f"""WITH d AS (SELECT run_id, r, r - avg(r) OVER (PARTITION BY run_id) AS e, row_number() OVER (PARTITION BY run_id ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM rets),
    c AS (SELECT a.run_id, b.i - a.i AS k, any_value(a.n) AS n, sum(a.e * b.e) AS c FROM d AS a JOIN d AS b ON a.run_id = b.run_id AND b.i - a.i BETWEEN 0 AND 50 GROUP BY 1, 2),
    calm AS (SELECT *, count(*) FILTER (abs(rho) < 2 * sqrt(log10(n) / n)) OVER (PARTITION BY run_id ORDER BY k RANGE BETWEEN 1 FOLLOWING AND 5 FOLLOWING) = 5 AS calm FROM (SELECT *, c / max(c) FILTER (k = 0) OVER (PARTITION BY run_id) AS rho FROM c)),
    m AS (SELECT run_id, least(2 * coalesce(min(k) FILTER (calm AND k BETWEEN 1 AND 45), 25), 50) AS m FROM calm GROUP BY 1),
    g AS (SELECT run_id, any_value(n) AS n, sum(k * c * (1 + cos(pi() * k / m))) / sum(CASE WHEN k = 0 THEN c ELSE c * (1 + cos(pi() * k / m)) END) AS g FROM c JOIN m USING (run_id) WHERE k <= m GROUP BY 1),
    len AS (SELECT run_id, n, greatest(least(CAST(ceil(pow(2 * g * g, 1 / 3e0) * pow(n, 1 / 3e0)) AS BIGINT), n // 2), 1) AS block FROM g),
    boot AS (SELECT run_id, draw, coalesce(avg(r) / nullif(stddev_samp(r), 0), 0) * sqrt(252) AS s FROM (
      SELECT run_id, draw, (CAST('0x' || substr(md5(draw || ':' || (p // block)), 1, 8) AS BIGINT) % n + p % block) % n AS i FROM (SELECT run_id, n, block, draw, unnest(range(n)) AS p FROM len CROSS JOIN (SELECT unnest(range(200)) AS draw))) JOIN d USING (run_id, i) GROUP BY 1, 2),
    j AS (SELECT run_id, avg(jack) OVER (PARTITION BY run_id) - jack AS gap FROM (SELECT run_id, (t - r) / (n - 1) / sqrt(((q - r * r) - pow(t - r, 2) / (n - 1)) / (n - 2)) * sqrt(252) AS jack FROM (SELECT *, sum(r) OVER (PARTITION BY run_id) AS t, sum(r * r) OVER (PARTITION BY run_id) AS q FROM d))),
    a AS (SELECT run_id, sum(gap * gap * gap) / (6 * pow(sum(gap * gap), 1.5)) AS a FROM j GROUP BY 1),
    p AS (SELECT run_id, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM rets GROUP BY 1),
    z AS (SELECT run_id, any_value(sharpe) AS sharpe, any_value(a) AS a, list(s ORDER BY s) AS s, avg(CAST(s > 0 AS DOUBLE)) AS p_positive, {ppf("greatest(least(avg(CAST(s < sharpe AS DOUBLE)), 1 - 1 / 201e0), 1 / 201e0)")} AS z0 FROM boot JOIN p USING (run_id) JOIN a USING (run_id) GROUP BY 1),
    q AS (SELECT *, {cdf("(z0 + (z0 - 1.9599639845400545e0) / (1 - a * (z0 - 1.9599639845400545e0)))")} * 199 AS lo, {cdf("(z0 + (z0 + 1.9599639845400545e0) / (1 - a * (z0 + 1.9599639845400545e0)))")} * 199 AS hi FROM z),
    pos AS (SELECT *, CAST(floor(lo) AS BIGINT) AS l, CAST(floor(hi) AS BIGINT) AS h FROM q)
    SELECT run_id, sharpe, s[l + 1] + (lo - l) * (s[least(l + 2, 200)] - s[l + 1]) AS ci_lower, s[h + 1] + (hi - h) * (s[least(h + 2, 200)] - s[h + 1]) AS ci_upper, p_positive, block FROM pos JOIN len USING (run_id)"""


@query("run_id", "block", "sharpe ci_lower ci_upper p_positive", _BOOT, "rets", places=6)
def bootstrap_sharpe(v):
    return inference.bootstrap_sharpe(v.rets)


def _gates(trials: int, pbo: str = "") -> str:
    """The verdict over `rets`. pbo: SQL of (run_id, pbo); without it that gate is neutral."""
    weights = [12, 9, 9, 8, 8, 9, 8, 8, 8, 6, 6] + [9] * bool(pbo)
    passed = " + ".join(f"g{k}" for k in range(1, len(weights) + 1))
    score = " + ".join(f"{w} * g{k}" for k, w in enumerate(weights, 1))
    return f"""SELECT run_id, p AS passed, {int(not pbo)} AS neutral, score, CASE WHEN score >= 70 THEN 'ROBUST' WHEN score >= 50 THEN 'MODERATE' WHEN score >= 30 THEN 'FRAGILE' ELSE 'OVERFIT' END AS grade,
    CASE WHEN dsr <= 0.5 OR sharpe <= 0 THEN 'REJECT' WHEN score >= 70 THEN 'PROMOTE' WHEN score >= 50 THEN 'CONDITIONAL' ELSE 'REJECT' END AS verdict FROM (SELECT *, ({score}) / {sum(weights)}.0 * 100 AS score, {passed} AS p FROM (
    SELECT o.run_id, dsr, sharpe, CAST(dsr > 0.5 AS INT) AS g1, CAST(haircut_pct < 0.5 AS INT) AS g2, CAST(psr > 0.95 AS INT) AS g3, CAST(harvey_t > 3 AS INT) AS g4, CAST(coalesce(mtrl <= n, false) AS INT) AS g5, CAST(CASE WHEN sharpe > 0 THEN mean_s / sharpe ELSE 0 END > 0.5 AS INT) AS g6, CAST(pos >= 0.6 AS INT) AS g7,
      CAST(coalesce(sd_s / abs(mean_s) < 0.5, false) AS INT) AS g8, CAST(sharpe > 0 AS INT) AS g9, CAST(worst > -0.5 AS INT) AS g10, CAST(ci_lower > 0 AS INT) AS g11{", CAST(pbo < 0.4 AS INT) AS g12" if pbo else ""}
    FROM ({_over(trials)}) AS o JOIN (SELECT run_id, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM rets GROUP BY 1) USING (run_id) JOIN (SELECT run_id, ci_lower FROM ({_BOOT})) USING (run_id) {f"JOIN ({pbo}) USING (run_id)" if pbo else ""}
    JOIN (SELECT run_id, avg(s) AS mean_s, stddev_samp(s) AS sd_s FROM (SELECT run_id, fold, avg(r) / stddev_samp(r) * sqrt(252) AS s FROM (SELECT *, ntile(8) OVER (PARTITION BY run_id ORDER BY dt) AS fold FROM rets) GROUP BY 1, 2) GROUP BY 1) USING (run_id)
    JOIN (SELECT run_id, avg(CAST(c > 0 AS DOUBLE)) AS pos, min(s) AS worst FROM (SELECT run_id, year(dt) AS y, exp(sum(ln(1 + r))) - 1 AS c, coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(252), 0) AS s FROM rets GROUP BY 1, 2) GROUP BY 1) USING (run_id)))"""


@query("run_id verdict grade", "passed neutral", "score", _gates(25), "rets", places=6)
def gate_verdict(v):
    return validation.verdict(validation.gate_rows(validation.gate_inputs(v.rets, 25)))


@query("symbol", "n", "kappa t_stat half_life", """SELECT symbol, n, -b AS kappa, b / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx) AS t_stat, CASE WHEN b < 0 THEN ln(2) / -b END AS half_life FROM (
    SELECT symbol, count(*) AS n, regr_slope(y, l) AS b, regr_sxx(y, l) AS sxx, regr_syy(y, l) AS syy, regr_sxy(y, l) AS sxy FROM (SELECT symbol, signal - lag(signal) OVER w AS y, lag(signal) OVER w AS l FROM sig WHERE signal IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY dt)) WHERE l IS NOT NULL GROUP BY 1)""", "px pr sig", places=6)  # fmt: skip
def half_life(v):
    return inference.half_life(v.sig, "signal", "symbol")


@query("", "n", "gross vol rho drag net gross_ir net_ir breadth icir_flam", """SELECT *, gross / vol AS gross_ir, net / vol AS net_ir, gross * sqrt(breadth) AS icir_flam FROM (SELECT *, gross - drag AS net, n * (1 - least(greatest(rho, -0.99), 0.99)) / (1 + least(greatest(rho, -0.99), 0.99)) AS breadth FROM (
    SELECT count(ic) AS n, avg(ic) AS gross, stddev_samp(ic) AS vol, corr(ic, l) AS rho, 0.3 * 5 / 1e4 / stddev_samp(ic) AS drag FROM (SELECT dt, ic, lag(ic) OVER (ORDER BY dt) AS l FROM (
    SELECT dt, corr(a, b) AS ic FROM (SELECT dt, CAST(rank() OVER (PARTITION BY dt ORDER BY signal) AS DOUBLE) AS a, CAST(rank() OVER (PARTITION BY dt ORDER BY fwd) AS DOUBLE) AS b FROM sig WHERE signal IS NOT NULL AND fwd IS NOT NULL) GROUP BY dt) WHERE ic IS NOT NULL AND isfinite(ic))))""", "px pr sig", places=6)  # fmt: skip
def ic_breadth(v):
    d = v.sig.where("signal is not null and fwd is not null")
    rank = lambda x: F.rank().over(Window.partitionBy("dt").orderBy(x)).cast("double")
    ics = d.withColumn("a", rank("signal")).withColumn("b", rank("fwd")).groupBy("dt").agg(F.corr("a", "b").alias("ic")).where("ic is not null and not isnan(ic)")
    return inference.breadth(ics.withColumn("family", F.lit("all")), 0.3, 5.0)


@query("symbol", "n", "mae rmse mape", "SELECT symbol, count(*) AS n, avg(abs(fwd - signal)) AS mae, sqrt(avg(pow(fwd - signal, 2))) AS rmse, avg(abs((fwd - signal) / fwd)) FILTER (abs(fwd) >= 1e-8) AS mape FROM sig WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY 1", "px pr sig", places=6)
def forecast_errors(v):
    return inference.forecast_errors(v.sig, "signal", "fwd", "symbol")


@query("", "n", "sharpe_a sharpe_b sharpe_diff z p_value rho diff_mean paired_t", f"""SELECT n, x * sqrt(252) AS sharpe_a, y * sqrt(252) AS sharpe_b, (x - y) * sqrt(252) AS sharpe_diff, z, 2 * {cdf('(-abs(z))')} AS p_value, rho, dm AS diff_mean, dm / ds * sqrt(n) AS paired_t FROM (
    SELECT *, (x - y) / sqrt((2 - 2 * rho + 0.5 * (x * x + y * y - 2 * x * y * rho * rho)) / n) AS z FROM (SELECT count(*) AS n, avg(a) / stddev_samp(a) AS x, avg(n) / stddev_samp(n) AS y, corr(a, n) AS rho, avg(a - n) AS dm, stddev_samp(a - n) AS ds FROM wide))""", "rets wide", places=6)  # fmt: skip
def sharpe_difference(v):
    return inference.sharpe_difference(v.wide, "a", "n")


@query("crash_convex", "n_up n_down", "up_capture down_capture capture_ratio", """SELECT *, up_capture / down_capture AS capture_ratio, up_capture > 0 AND down_capture >= 0 AND down_capture < up_capture AS crash_convex FROM (
    SELECT count(*) FILTER (n >= hi) AS n_up, count(*) FILTER (n <= lo) AS n_down, avg(a) FILTER (n >= hi) / avg(n) FILTER (n >= hi) AS up_capture, avg(a) FILTER (n <= lo) / avg(n) FILTER (n <= lo) AS down_capture FROM wide CROSS JOIN (SELECT quantile_cont(n, 0.1) AS lo, quantile_cont(n, 0.9) AS hi FROM wide))""", "rets wide", places=6)  # fmt: skip
def stress_capture(v):
    return inference.stress_capture(v.wide, "a", "n")


_BOOK = """SELECT yr AS period, sector, w / sum(w) OVER (PARTITION BY yr) AS w, r, CAST(c AS DOUBLE) / sum(c) OVER (PARTITION BY yr) AS bw, br FROM (
    SELECT year(o_orderdate) AS yr, o_orderpriority AS sector, sum(o_totalprice) AS w, avg(o_totalprice) / 1e6 AS r, count(*) AS c, median(o_totalprice) / 1e6 AS br FROM orders GROUP BY 1, 2)"""


@query("sector", "periods", "allocation selection interaction", f"SELECT sector, count(*) AS periods, avg((w - bw) * (br - t)) AS allocation, avg(bw * (r - br)) AS selection, avg((w - bw) * (r - br)) AS interaction FROM (SELECT *, sum(bw * br) OVER (PARTITION BY period) AS t FROM ({_BOOK})) GROUP BY 1", places=8)
def brinson_fachler(v):
    g = v.table("orders").groupBy(F.year("o_orderdate").alias("period"), F.col("o_orderpriority").alias("sector"))
    g = g.agg(F.sum("o_totalprice").alias("w"), (F.avg("o_totalprice") / 1e6).alias("r"), F.count("*").alias("c"), (F.median("o_totalprice") / 1e6).alias("br"))
    of = Window.partitionBy("period")
    book = g.withColumn("w", F.col("w") / F.sum("w").over(of)).withColumn("bw", F.col("c") / F.sum("c").over(of))
    return inference.brinson(book).groupBy("sector").agg(F.count("*").alias("periods"), *[F.avg(x).alias(x) for x in ("allocation", "selection", "interaction")])


@query("run_id exposure", "n", "win_rate ac1", """SELECT *, CASE WHEN n < 50 THEN 'neutral' WHEN win_rate > 0.55 AND abs(ac1) < 0.1 THEN 'positive_theta' WHEN win_rate < 0.45 AND ac1 > 0 THEN 'negative_theta' ELSE 'neutral' END AS exposure FROM (
    SELECT run_id, count(*) AS n, avg(CAST(r > 0 AS DOUBLE)) AS win_rate, corr(r, l) AS ac1 FROM (SELECT run_id, r, lag(r) OVER (PARTITION BY run_id ORDER BY dt) AS l FROM rets) GROUP BY 1)""", "rets", places=6)  # fmt: skip
def theta_exposure(v):
    return inference.theta_exposure(v.rets)


@query("symbol verdict", "n", "hit_rate statistic p_value", f"""SELECT symbol, n, h AS hit_rate, z AS statistic, 2 * {cdf('(-abs(z))')} AS p_value, CASE WHEN 2 * {cdf('(-abs(z))')} < 0.05 THEN CASE WHEN z > 0 THEN 'DIRECTIONAL_SKILL' ELSE 'ANTI_DIRECTIONAL' END ELSE 'NO_DIRECTIONAL_SKILL' END AS verdict FROM (SELECT *, (h - e) / sqrt(e * (1 - e) / n - (pow(2 * p - 1, 2) * q * (1 - q) / n + pow(2 * q - 1, 2) * p * (1 - p) / n + 4 * p * q * (1 - p) * (1 - q) / (n * n))) AS z FROM (
    SELECT *, p * q + (1 - p) * (1 - q) AS e FROM (SELECT symbol, CAST(count(*) AS DOUBLE) AS n, avg(CAST((signal > 0) = (fwd > 0) AS DOUBLE)) AS h, avg(CAST(fwd > 0 AS DOUBLE)) AS p, avg(CAST(signal > 0 AS DOUBLE)) AS q FROM sig WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY 1)))""", "px pr sig", places=6)  # fmt: skip
def directional_verdict(v):
    d = diagnosis.pesaran_timmermann(v.sig, "symbol", "signal", "fwd").withColumn("p_value", stats.two_sided("statistic"))
    z = F.col("statistic")
    return d.withColumn("verdict", F.when(F.col("p_value") < 0.05, F.when(z > 0, "DIRECTIONAL_SKILL").otherwise("ANTI_DIRECTIONAL")).otherwise("NO_DIRECTIONAL_SKILL"))


@query("run_id", "days", "current_dd upi", """SELECT run_id, CASE WHEN last_dd < -1e-10 THEN days ELSE 0 END AS days, CASE WHEN last_dd < -1e-10 THEN last_dd ELSE 0 END AS current_dd, g / (ulcer / 100) AS upi FROM (
    SELECT run_id, arg_max(drawdown, dt) AS last_dd, count(*) FILTER (dt > top) AS days, sqrt(avg(pow(100 * drawdown, 2))) AS ulcer, exp(sum(ln(1 + r)) * 252 / count(r)) - 1 AS g FROM (SELECT *, max(CASE WHEN drawdown >= -1e-10 THEN dt END) OVER (PARTITION BY run_id) AS top FROM dd) GROUP BY 1)""", "rets dd", places=6)  # fmt: skip
def current_underwater(v):
    from tessella.functions import metrics as m

    d = simulate.equity(v.rets, "run_id")
    top = F.max(F.when(F.col("drawdown") >= -1e-10, F.col("dt"))).over(Window.partitionBy("run_id"))
    d = d.withColumn("top", top).groupBy("run_id").agg(F.max_by("drawdown", "dt").alias("now"), F.count_if(F.col("dt") > F.coalesce("top", F.lit("0001-01-01").cast("date"))).alias("days"), F.sqrt(F.avg((100 * F.col("drawdown")) ** 2)).alias("ulcer"), m.cagr("r").alias("g"))
    under = F.col("now") < -1e-10
    return d.select("run_id", F.when(under, F.col("days")).otherwise(0).alias("days"), F.when(under, F.col("now")).otherwise(0.0).alias("current_dd"), (F.col("g") / (F.col("ulcer") / 100)).alias("upi"))


@query("run_id start_dt trough_dt recovery_dt", "bars to_trough", "depth", """SELECT run_id, start_dt, trough_dt, CAST((SELECT min(d2.dt) FROM dd AS d2 WHERE d2.run_id = e.run_id AND d2.dt > e.end_dt) AS VARCHAR) AS recovery_dt, bars, (SELECT count(*) FROM dd AS d3 WHERE d3.run_id = e.run_id AND d3.dt >= e.start_dt AND d3.dt < e.trough_dt) AS to_trough, depth FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY depth, start_dt) AS k FROM (SELECT run_id, min(dt) AS start_dt, max(dt) AS end_dt, arg_min(dt, drawdown) AS trough_dt, count(*) AS bars, min(drawdown) AS depth FROM (
    SELECT *, sum(c) OVER (PARTITION BY run_id ORDER BY dt) AS isl FROM (SELECT *, CASE WHEN (drawdown < -1e-10) IS DISTINCT FROM lag(drawdown < -1e-10) OVER (PARTITION BY run_id ORDER BY dt) THEN 1 ELSE 0 END AS c FROM dd)) WHERE drawdown < -1e-10 GROUP BY run_id, isl)) AS e WHERE k <= 10""", "rets dd")  # fmt: skip
def top_drawdowns(v):
    return simulate.top_drawdowns(v.rets, 10).withColumn("recovery_dt", F.col("recovery_dt").cast("string"))
