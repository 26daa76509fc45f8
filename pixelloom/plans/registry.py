"""All registered queries of the pixel-table operators, with the SQL they must agree with.

Floating results are rounded on both sides, to fewer places where values are large.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.cdf import chi2_cdf_sql
from ..operators import change, classify, cluster, focal, local, metrics, moments, series
from ..sources import adapters as A

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
FLAGSHIP = "imad_two_band"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rnd(df: DataFrame, places: int = 6, skip: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded."""
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def rnd_scaled(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded as in the SQL: scaled, then to whole numbers.  ``rnd`` goes by the shortest
    decimal, which can lie on the other side of a half."""
    whole = lambda c: F.round(F.col(c) * 10.0**places) / 10.0**places
    return df.select(*[(F.when(F.abs(whole(c)) < float("inf"), whole(c)).otherwise(F.col(c)) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def R(x: str, name: str, places: int = 6) -> str:  # noqa: N802
    return f"round({x}, {places}) + 0.0 AS {name}"


# ------------------------------------------------------------- moments

_B = ("b1", "b3", "b4")


@query(f"WITH {A.PIXELS} SELECT cls, count(*) AS n, " + ", ".join(R(f"avg({b})", f"mean_{b}") for b in _B) + ", " + ", ".join(R(f"covar_samp({a}, {b})", f"cov_{a}_{b}") for a, b in combinations_with_replacement(_B, 2)) + " FROM pixels GROUP BY cls")
def moments_by_class(spark, sf):
    return rnd(moments.moments(A.pixels(spark, sf), list(_B), ["cls"]))


_W = "(b3 + 0.5)"


@query(
    f"WITH {A.PIXELS}, m AS (SELECT sum({_W}) AS sw, sum({_W} * b1) / sum({_W}) AS m1, sum({_W} * b4) / sum({_W}) AS m4 FROM pixels) SELECT {R('max(sw)', 'sum_w')}, {R('max(m1)', 'mean_b1')}, {R('max(m4)', 'mean_b4')}, "
    + ", ".join(R(f"sum({_W} * (b{i} - m{i}) * (b{j} - m{j})) / (max(sw) - 1)", f"cov_b{i}_b{j}") for i, j in ((1, 1), (1, 4), (4, 4)))
    + " FROM pixels, m"
)
def weighted_covariance(spark, sf):
    return rnd(moments.weighted_moments(A.pixels(spark, sf), ["b1", "b4"], F.col("b3") + 0.5))


@query(
    f"WITH {A.GRID}, d AS (SELECT lead(y) OVER w AS ny, y, lead(b1) OVER w - b1 AS b1, lead(b3) OVER w - b3 AS b3 FROM grid WINDOW w AS (PARTITION BY x ORDER BY y)) "
    f"SELECT count(*) AS n, {R('covar_samp(b1, b1) / 2', 'cov_b1_b1')}, {R('covar_samp(b1, b3) / 2', 'cov_b1_b3')}, {R('covar_samp(b3, b3) / 2', 'cov_b3_b3')} FROM d WHERE ny = y + 1"
)
def noise_covariance(spark, sf):
    return rnd(moments.noise_covariance(A.grid(spark, sf), ["b1", "b3"]))


@query(
    f"WITH {A.PIXELS}, j AS (SELECT floor(b1 / 5) AS a, round(b3 * 100) AS b, count(*) AS c FROM pixels GROUP BY 1, 2), t AS (SELECT *, sum(c) OVER (PARTITION BY a) AS ca, sum(c) OVER (PARTITION BY b) AS cb, sum(c) OVER () AS n FROM j) "
    f"SELECT {R('sum(c / n * ln(c * n / (ca * cb)))', 'mi')} FROM t"
)
def mutual_information(spark, sf):
    return rnd(moments.mutual_information(A.pixels(spark, sf), F.floor(F.col("b1") / 5), F.round(F.col("b3") * 100)))


@query(
    f"WITH {A.PAIR}, m AS (SELECT avg(a1) AS mx, avg(c1) AS my, var_samp(a1) AS sxx, var_samp(c1) AS syy, covar_samp(a1, c1) AS sxy, corr(a1, c1) AS r FROM pair), "
    "s AS (SELECT *, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) AS slope FROM m) "
    f"SELECT {R('slope', 'slope', 4)}, {R('my - slope * mx', 'intercept', 4)}, {R('r', 'r', 4)} FROM s"
)
def orthogonal_regression(spark, sf):
    return rnd(moments.orthogonal_regression(A.pair(spark, sf), "a1", "c1"), 4)


@query(f"WITH {A.PIXELS} SELECT cls, {R('regr_slope(b2, b1)', 'slope', 3)}, {R('regr_intercept(b2, b1)', 'intercept', 3)}, {R('corr(b2, b1)', 'r')} FROM pixels GROUP BY cls")
def linear_regression_by_class(spark, sf):
    out = moments.linear_regression(A.pixels(spark, sf), "b1", "b2", ["cls"])
    return out.select("cls", F.round("slope", 3).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r", 6).alias("r"))


def _ols_sql(ridge: float) -> str:
    return (
        f"WITH {A.PIXELS}, m AS (SELECT count(*) - 1 AS k, covar_samp(b1, b1) AS s11, covar_samp(b3, b3) AS s22, covar_samp(b1, b3) AS s12, covar_samp(b1, b4) AS t1, covar_samp(b3, b4) AS t2, avg(b1) AS m1, avg(b3) AS m3, avg(b4) AS my FROM pixels), "
        f"n AS (SELECT s11 * k + {ridge} AS s11, s22 * k + {ridge} AS s22, s12 * k AS s12, t1 * k AS t1, t2 * k AS t2, m1, m3, my FROM m), "
        "b AS (SELECT (s22 * t1 - s12 * t2) / (s11 * s22 - s12 * s12) AS x1, (s11 * t2 - s12 * t1) / (s11 * s22 - s12 * s12) AS x2, m1, m3, my FROM n) "
        f"SELECT {R('x1', 'beta1', 8)}, {R('x2', 'beta2', 8)}, {R('my - x1 * m1 - x2 * m3', 'intercept', 8)} FROM b"
    )


@query(_ols_sql(0.0))
def ordinary_least_squares(spark, sf):
    return rnd(moments.two_band_ols(A.pixels(spark, sf), "b1", "b3", "b4"), 8)


@query(_ols_sql(10.0))
def ridge_regression(spark, sf):
    return rnd(moments.two_band_ols(A.pixels(spark, sf), "b1", "b3", "b4", 10.0), 8)


# ------------------------------------------------------------- local

_BYTE = "byte AS (SELECT x, y, floor(least(greatest((b1 - lo) * 255 / (hi - lo), 0.0), 255.0))::INTEGER AS byte FROM grid, (SELECT min(b1) AS lo, max(b1) AS hi FROM grid))"
_HIST = "hist AS (SELECT byte AS b, c, sum(c) OVER (ORDER BY byte) AS cum, sum(c) OVER () AS total FROM (SELECT byte, count(*) AS c FROM byte GROUP BY byte))"


@query(f"WITH {A.GRID}, {_BYTE} SELECT x, y, byte FROM byte")
def byte_stretch(spark, sf):
    return local.byte_stretch(A.grid(spark, sf), "b1").select("x", "y", "byte")


@query(f"WITH {A.GRID}, {_BYTE}, {_HIST} SELECT x, y, floor(255 * cum / total)::INTEGER AS equalized FROM byte JOIN hist ON b = byte")
def hist_equalize(spark, sf):
    return local.hist_equalize(A.grid(spark, sf), "b1").select("x", "y", "equalized")


@query(f"WITH {A.GRID}, {_BYTE}, {_HIST} SELECT b, c, cum::BIGINT AS cum, total::BIGINT AS total FROM hist")
def byte_histogram(spark, sf):
    return local.histogram(local.byte_stretch(A.grid(spark, sf), "b1"))


@query(
    f"WITH {A.GRID}, {_BYTE}, {_HIST}, cut AS (SELECT min(b) FILTER (WHERE cum / total >= 0.02) AS lo, max(b) FILTER (WHERE cum / total <= 0.98) AS hi FROM hist) "
    "SELECT x, y, floor(least(greatest((byte - lo) * 255 / (hi - lo), 0.0), 255.0))::INTEGER AS stretched FROM byte, cut"
)
def stretch_2pc(spark, sf):
    return local.stretch_2pc(A.grid(spark, sf), "b1").select("x", "y", "stretched")


@query(
    "WITH s AS (SELECT least(min(value), 0.0) AS lo, avg(value) AS mean FROM events), l AS (SELECT event_id, ln(CASE WHEN value - lo = 0 THEN mean - lo ELSE value - lo END) AS v FROM events, s), m AS (SELECT min(v) AS a, max(v) AS b FROM l) "
    f"SELECT event_id, {R('(v - a) * 255 / (b - a)', 'enhanced')} FROM l, m"
)
def log_enhance(spark, sf):
    return rnd(local.log_enhance(A.table(spark, sf, "events").select("event_id", "value"), "value").select("event_id", "enhanced"))


@query(f"WITH {A.GRID}, m AS (SELECT min(b1) AS lo, max(b1) AS hi FROM grid) SELECT x, y, {R('2 * (b1 - lo) / (hi - lo) - 1', 's_b1')} FROM grid, m")
def minmax_scale(spark, sf):
    return rnd(local.minmax_scale(A.grid(spark, sf), ["b1"]).select("x", "y", "s_b1"))


@query(f"WITH {A.PAIR} SELECT id, {R('(c1 - a1) / (c1 + a1)', 'nd')} FROM pair WHERE a1 + c1 <> 0")
def normalized_difference(spark, sf):
    return rnd(A.pair(spark, sf).select("id", local.normalized_difference(F.col("c1"), F.col("a1")).alias("nd")).filter("nd is not null"))


@query(f"WITH {A.GRID} SELECT floor(x / 4)::BIGINT AS x, floor(y / 4)::BIGINT AS y, {R('avg(b1)', 'b1', 10)}, {R('avg(b3)', 'b3', 10)} FROM grid GROUP BY 1, 2")
def block_mean(spark, sf):
    return rnd(local.block_mean(A.grid(spark, sf), 4, ["b1", "b3"]), 10)


@query(f"WITH {A.GRID} SELECT x, y, {R('b3', 'b3')}, {R('b1', 'b1')} FROM grid WHERE x >= 10 AND x < 40 AND y >= 5 AND y < 65")
def subset_window(spark, sf):
    return rnd(local.subset(A.grid(spark, sf), (10, 5, 30, 60), ["b3", "b1"]))


@query(f"SELECT event_id, {R('exp(value / 50 * ln(10.0) / 10)', 'linear')} FROM events")
def db_to_linear(spark, sf):
    return rnd(A.table(spark, sf, "events").select("event_id", local.db_to_linear(F.col("value") / 50).alias("linear")))


@query(f"WITH {A.GRID} SELECT x, y, {R('b1 * b4 - (b3 * b3 + b4 * b4)', 'det4', 13)}, {R('b1 * b3 * b4', 'det3', 13)}, {R('ln(b1 + b4 + 0.001)', 'log_span')} FROM grid")
def determinants(spark, sf):
    b1, b3, b4 = F.col("b1"), F.col("b3"), F.col("b4")
    return rnd(A.grid(spark, sf).select("x", "y", (F.round(local.determinant([b1, b3, b4, b4]), 13) + 0.0).alias("det4"), (F.round(local.determinant([b1, b3, b4]), 13) + 0.0).alias("det3"), local.span([b1, b3, b4, b4], log=True).alias("log_span")), 6, ("det3", "det4"))


@query(f"WITH {A.GRID} SELECT x, y, {R('cos(b3) * cos(0.7) + sin(b3) * sin(0.7) * cos(2.1 - b1)', 'cos_i')} FROM grid")
def incidence_cosine(spark, sf):
    return rnd(A.grid(spark, sf).select("x", "y", local.solar_incidence(F.lit(0.7), F.lit(2.1), F.col("b3"), F.col("b1")).alias("cos_i")))


@query(f"SELECT {R('quantile_cont(value, 0.02)', 'p2')}, {R('quantile_cont(value, 0.98)', 'p98')} FROM events")
def percentiles(spark, sf):
    return rnd(local.percentiles(A.table(spark, sf, "events"), "value"))


@query(f"WITH {A.PIXELS}, m AS (SELECT cls, regr_slope(b1, b3 + 0.3) AS s, regr_intercept(b1, b3 + 0.3) AS i, corr(b1, b3 + 0.3) AS r FROM pixels GROUP BY cls) SELECT id, b1, cls, {R('CASE WHEN r > -1 THEN b1 * (0.8 + i / s) / (b3 + 0.3 + i / s) ELSE b1 END', 'corrected', 4)} FROM pixels JOIN m USING (cls)")
def c_correction(spark, sf):
    px = A.pixels(spark, sf).withColumn("cosi", F.col("b3") + 0.3)
    return rnd(change.c_correction(px, "b1", "cosi", 0.8, "cls", -1.0).select("id", "b1", "cls", "corrected"), 4, ("b1",))


# ------------------------------------------------------------- change

_MAD = "m AS (SELECT avg(a1) AS mx, avg(c1) AS my, stddev_samp(a1) AS sx, stddev_samp(c1) AS sy, corr(a1, c1) AS r FROM pair), d AS (SELECT id, (a1 - mx) / sx - sign(r) * (c1 - my) / sy AS mad, r FROM pair, m), t AS (SELECT id, mad, mad * mad / (2 * (1 - abs(r))) AS chi2 FROM d)"


@query(f"WITH {A.PAIR}, {_MAD} SELECT id, {R('mad', 'mad')}, {R('chi2', 'chi2')} FROM t")
def mad_single_band(spark, sf):
    return rnd(change.mad_single_band(A.pair(spark, sf), "a1", "c1").select("id", "mad", "chi2"))


@query(f"WITH {A.PAIR}, {_MAD}, p AS (SELECT id, 1 - {chi2_cdf_sql('chi2', 1)} AS p FROM t) SELECT id, {R('p', 'p_nochange')}, p <= 0.95 AS changed FROM p")
def change_map(spark, sf):
    mad = change.mad_single_band(A.pair(spark, sf), "a1", "c1")
    return rnd(change.change_map(mad, 1).select("id", "p_nochange", "changed"))


@query(
    f"WITH {A.PAIR}, {_MAD}, k AS (SELECT a1, c1, (id * 2654435761) % 1000 < 667 AS train FROM pair JOIN t USING (id) WHERE 1 - {chi2_cdf_sql('chi2', 1)} > 0.2), "
    "f AS (SELECT avg(a1) AS mx, avg(c1) AS my, var_samp(a1) AS sxx, var_samp(c1) AS syy, covar_samp(a1, c1) AS sxy FROM k WHERE train), "
    "g AS (SELECT *, (syy - sxx + sqrt((syy - sxx) * (syy - sxx) + 4 * sxy * sxy)) / (2 * sxy) AS b FROM f) "
    f"SELECT {R('max(b)', 'slope', 4)}, {R('max(my - b * mx)', 'intercept', 4)}, count(*) AS n_test, {R('avg(c1 - (my - b * mx + b * a1))', 'mean_error', 4)}, {R('stddev_samp(c1 - (my - b * mx + b * a1))', 'sd_error', 4)} FROM k, g WHERE NOT train"
)
def radiometric_normalization(spark, sf):
    mad = change.change_map(change.mad_single_band(A.pair(spark, sf), "a1", "c1"), 1)
    train = F.pmod(F.col("id") * 2654435761, F.lit(1000)) < 667
    return rnd(change.radiometric_normalization(mad, "a1", "c1", F.col("p_nochange") > 0.2, train), 4)


def _imad_sql() -> str:
    """Each round is a table; the first round whose correlations have settled, or the last, is
    the result.  Rounds are written out, as aggregates may not stand in a recursion."""
    parts = ["x AS (SELECT id, a1 - avg(a1) OVER () AS a, a3 - avg(a3) OVER () AS b, c1 - avg(c1) OVER () AS c, c3 - avg(c3) OVER () AS d FROM pair), f0 AS (SELECT 0.0 AS rho1, 0.0 AS rho2, FALSE AS done)"]
    mad = lambda i: f"(p{i} * (a - ma) + q{i} * (b - mb) - r{i} * (c - mc) - s{i} * (d - md))"
    chi = f"({mad(1)} * {mad(1)} / (2 * (1 - rho1)) + {mad(2)} * {mad(2)} / (2 * (1 - rho2)))"
    for t in range(1, 51):
        w = "1.0" if t == 1 else f"exp(-{chi} / 2)"
        src = "x, f0" if t == 1 else f"x, f{t - 1}"
        sums = ", ".join(f"sum(w * {u} * {v}) / (sum(w) - 1) - sum(w * {u}) * sum(w * {v}) / sum(w) / (sum(w) - 1) AS {u}{v}" for i, u in enumerate("abcd") for v in "abcd"[i:])
        parts.append(f"w{t} AS (SELECT a, b, c, d, {w} AS w FROM {src} WHERE NOT done)")
        parts.append(f"s{t} AS (SELECT " + ", ".join(f"sum(w * {u}) / sum(w) AS m{u}" for u in "abcd") + f", {sums} FROM w{t})")
        # M = S11^-1 S12 S22^-1 S21; its values are squared correlations.
        parts.append(f"n{t} AS (SELECT *, aa * bb - ab * ab AS d1, cc * dd - cd * cd AS d2, (dd * ac - cd * ad) AS e11, (dd * bc - cd * bd) AS e12, (cc * ad - cd * ac) AS e21, (cc * bd - cd * bc) AS e22 FROM s{t})")
        parts.append(f"h{t} AS (SELECT *, ac * e11 / d2 + ad * e21 / d2 AS g11, ac * e12 / d2 + ad * e22 / d2 AS g12, bc * e11 / d2 + bd * e21 / d2 AS g21, bc * e12 / d2 + bd * e22 / d2 AS g22 FROM n{t})")
        parts.append(f"k{t} AS (SELECT *, (bb * g11 - ab * g21) / d1 AS m11, (bb * g12 - ab * g22) / d1 AS m12, (aa * g21 - ab * g11) / d1 AS m21, (aa * g22 - ab * g12) / d1 AS m22 FROM h{t})")
        parts.append(f"l{t} AS (SELECT *, (m11 + m22 + sqrt((m11 - m22) * (m11 - m22) + 4 * m12 * m21)) / 2 AS l1, (m11 + m22 - sqrt((m11 - m22) * (m11 - m22) + 4 * m12 * m21)) / 2 AS l2 FROM k{t})")
        vec = ", ".join(f"m12 / sqrt(aa * m12 * m12 + 2 * ab * m12 * (l{i} - m11) + bb * (l{i} - m11) * (l{i} - m11)) AS u{i}, (l{i} - m11) / sqrt(aa * m12 * m12 + 2 * ab * m12 * (l{i} - m11) + bb * (l{i} - m11) * (l{i} - m11)) AS v{i}, sqrt(greatest(l{i}, 0)) AS rho{i}" for i in (1, 2))
        parts.append(f"v{t} AS (SELECT *, {vec} FROM l{t})")
        # The sign: the first half's vector correlates positively, in sum, with its bands.
        sg = lambda i: f"(CASE WHEN (aa * u{i} + ab * v{i}) / sqrt(aa) + (ab * u{i} + bb * v{i}) / sqrt(bb) < 0 THEN -1 ELSE 1 END)"
        out = ", ".join(f"{sg(i)} * u{i} AS p{i}, {sg(i)} * v{i} AS q{i}, {sg(i)} * (e11 * u{i} + e12 * v{i}) / d2 / rho{i} AS r{i}, {sg(i)} * (e21 * u{i} + e22 * v{i}) / d2 / rho{i} AS s{i}, rho{i}" for i in (1, 2))
        done = f"greatest(abs(rho1 - (SELECT max(rho1) FROM f{t - 1})), abs(rho2 - (SELECT max(rho2) FROM f{t - 1}))) <= 0.001"
        parts.append(f"f{t} AS MATERIALIZED (SELECT *, {done} AS done, {t} AS round FROM (SELECT ma, mb, mc, md, {out} FROM v{t} WHERE aa IS NOT NULL))")
    last = " UNION ALL ".join(f"SELECT ma, mb, mc, md, p1, q1, r1, s1, p2, q2, r2, s2, rho1, rho2, round FROM f{t}" for t in range(1, 51))
    return f"WITH {A.PAIR}, {', '.join(parts)}, m AS (SELECT * FROM ({last}) ORDER BY round DESC LIMIT 1), y AS (SELECT id, {mad(2)} AS mad1, {mad(1)} AS mad2, {chi} AS chi2 FROM x, m) SELECT id, {R('mad1', 'mad1', 4)}, {R('mad2', 'mad2', 4)}, {R('chi2', 'chi2', 3)}, {R('exp(-chi2 / 2)', 'p_nochange', 4)} FROM y"


@query(_imad_sql())
def imad_two_band(spark, sf):
    out, _ = change.imad(A.pair(spark, sf), ["a1", "a3"], ["c1", "c3"])
    return rnd(rnd(out.select("id", "mad1", "mad2", "chi2", "p_nochange"), 4, ("chi2",)), 3, ("mad1", "mad2", "p_nochange"))


@query()
def imad_four_band(spark, sf):
    out, _ = change.imad(A.pair(spark, sf), [f"a{i}" for i in range(1, 5)], [f"c{i}" for i in range(1, 5)])
    return out.select("id", F.round("chi2", 6).alias("chi2"), F.round("p_nochange", 6).alias("p_nochange"))


_K, _N = 5, 5.0
_ARR = "arr AS (SELECT pix, list(v ORDER BY t) AS v FROM series GROUP BY pix HAVING count(*) = 5)"
#: Bands -> (determinant of the matrix {m}, p of ln R, p of its distribution, degrees of freedom).
_MATRIX = {
    1: (lambda m: m[0], 1, 1, 1), 2: (lambda m: f"({m[0]} * {m[1]})", 2, 1, 2), 3: (lambda m: f"({m[0]} * {m[1]} * {m[2]})", 3, 1, 3),
    4: (lambda m: f"({m[0]} * {m[3]} - ({m[1]} * {m[1]} + {m[2]} * {m[2]}))", 2, 2, 4),
}


def _omnibus_sql(bands: list[str] = ["v"]) -> str:  # noqa: B006
    """The sequential tests; rho and omega2 are worked out by the SQL itself."""
    det, p, q, f = _MATRIX[len(bands)]
    parts = []
    for ell in range(1, _K):
        for j in range(2, _K - ell + 2):
            s = lambda m: "ln(" + det([f"(list_sum({b}[{ell}:{ell + m - 1}]) * {_N})" for b in bands]) + ")"  # noqa: B023, E731
            now = "ln(" + det([f"({b}[{ell + j - 1}] * {_N})" for b in bands]) + ")"
            ln = f"({_N} * ({p} * ({j} * ln({j}.0) - {j - 1} * ln({j - 1}.0)) + {j - 1} * {s(j - 1)} + {now} - {j} * {s(j)}))"
            parts.append(f"SELECT pix, {ell} AS ell, {j} AS j, {ln} AS ln_r FROM arr")
    rho = f"1 - (2 * {q} * {q} - 1) * (1 + 1.0 / (j * (j - 1))) / (6 * {q} * {_N})"
    w = f"-({f} / 4.0) * (1 - 1 / rho) * (1 - 1 / rho) + {q * q * (q * q - 1)} * (1 + (2.0 * j - 1) / (j * j * (j - 1) * (j - 1))) / (24 * {_N} * {_N} * rho * rho)"
    prob = f"1 - ((1 - w) * {chi2_cdf_sql('z', f)} + w * {chi2_cdf_sql('z', f + 4)})"
    return f"lnr AS ({' UNION ALL '.join(parts)}), con AS (SELECT *, {rho} AS rho FROM lnr), con2 AS (SELECT *, {w} AS w, -2 * rho * ln_r AS z FROM con), tests AS (SELECT pix, ell, j, ln_r, {prob} AS p FROM con2)"


def _tests(spark, sf):
    return change.omnibus(change.series_arrays(A.series(spark, sf), _K), _K, _N)


@query(f"WITH {A.SERIES}, {_ARR}, {_omnibus_sql()} SELECT pix, ell, j, {R('ln_r', 'ln_r')}, {R('p', 'p')} FROM tests")
def omnibus_factors(spark, sf):
    return rnd(_tests(spark, sf))


def _q_sql() -> str:
    rho = f"(1 - ({_K} / {_N} - 1 / ({_N} * {_K})) / (6.0 * {_K - 1}))"
    w = f"(-{_K - 1} * (1 - 1 / {rho}) * (1 - 1 / {rho}) / 4)"
    ln = f"({_N} * ({_K} * ln({_K}.0) + list_sum([ln(x) FOR x IN v]) - {_K} * ln(list_sum(v))))"
    z = f"(-2 * {rho} * {ln})"
    return f"SELECT pix, {R(ln, 'ln_q')}, {R(f'1 - ((1 - {w}) * {chi2_cdf_sql(z, 4)} + {w} * {chi2_cdf_sql(z, 8)})', 'p')} FROM arr"


@query(f"WITH {A.SERIES}, {_ARR} {_q_sql()}")
def omnibus_q(spark, sf):
    return rnd(change.omnibus_q(change.series_arrays(A.series(spark, sf), _K), _K, _N))


_STEP = "{'cmap': CASE WHEN x.low AND a.cmap = x.ell - 1 THEN x.ell + x.j - 2 ELSE a.cmap END, 'smap': CASE WHEN x.low AND a.cmap = x.ell - 1 AND x.ell = 1 THEN x.ell + x.j - 2 ELSE a.smap END, 'at': CASE WHEN x.low AND a.cmap = x.ell - 1 THEN list_append(a.at, x.ell + x.j - 2) ELSE a.at END}"
#: The fold over tests with a flag ``low``, as r(pix, i, a).
_FOLD = (
    "o AS (SELECT pix, ell, j, low, row_number() OVER (PARTITION BY pix ORDER BY ell, j) AS i FROM flags), "
    f"r(pix, i, a) AS (SELECT DISTINCT pix, 0::BIGINT, {{'cmap': 0, 'smap': 0, 'at': []::INTEGER[]}} FROM o UNION ALL SELECT r.pix, x.i, {_STEP} FROM r JOIN o x ON x.pix = r.pix AND x.i = r.i + 1), "
    f"maps AS (SELECT pix, a.cmap::INTEGER AS cmap, a.smap::INTEGER AS smap, len(a.at)::INTEGER AS fmap, [CASE WHEN list_contains(a.at, i) THEN 255 ELSE 0 END FOR i IN range(1, {_K})] AS bmap FROM r WHERE i = {_K * (_K - 1) // 2})"
)


@query(f"WITH RECURSIVE {A.SERIES}, {_ARR}, {_omnibus_sql()}, flags AS (SELECT *, p <= 0.01 AS low FROM tests), {_FOLD} SELECT pix, cmap, smap, fmap FROM maps")
def omnibus_change_maps(spark, sf):
    return change.change_maps(_tests(spark, sf), 0.01)


@query(f"SELECT time_bucket(INTERVAL '6 days', ts, TIMESTAMP '1970-01-01')::TIMESTAMP AS start, count(*) AS n, {R('avg(value)', 'mean')}, {R('var_samp(value)', 'var', 4)} FROM events GROUP BY 1")
def tumbling_moments(spark, sf):
    ev = A.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    t = change.tumbling_moments(ev, "ts", "value", "6 days")
    return t.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", F.round("mean", 6).alias("mean"), F.round("var", 4).alias("var"))


# ------------------------------------------------------------- focal and series


def _near(offsets: str) -> str:
    return f"n AS (SELECT g.x - o.dx AS x, g.y - o.dy AS y, g.b1 AS v, o.w AS w, o.dx = 0 AND o.dy = 0 AS own FROM grid g, (VALUES {offsets}) o(dx, dy, w))"


def _values(k: dict[tuple[int, int], float]) -> str:
    return ", ".join(f"({dx}, {dy}, {float(w)}::DOUBLE)" for (dx, dy), w in k.items())


@query(f"WITH {A.GRID}, {_near(_values(focal.square(1)))} SELECT x, y, {R('median(v)', 'v')} FROM n GROUP BY x, y HAVING bool_or(own)")
def median_3x3(spark, sf):
    return rnd(focal.median_3x3(A.grid(spark, sf), "b1"))


@query(f"WITH {A.GRID}, {_near(_values(focal.SOBEL_X))} SELECT x, y, {R('sum(v * w)', 'v')} FROM n GROUP BY x, y HAVING count(*) = 6")
def sobel_x(spark, sf):
    return rnd(focal.convolve(A.grid(spark, sf), focal.SOBEL_X, "b1"))


@query(f"WITH {A.GRID}, {_near(_values(focal.LAPLACE))} SELECT x, y, {R('sum(v * w)', 'v')} FROM n GROUP BY x, y HAVING count(*) = 5")
def laplace(spark, sf):
    return rnd(focal.convolve(A.grid(spark, sf), focal.LAPLACE, "b1"))


@query(f"WITH {A.GRID}, {_near('(1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0), (0, 0, 0.0)')}, r AS (SELECT x, y, sum(v * w) / nullif(sum(w), 0) AS v FROM n GROUP BY x, y HAVING bool_or(own)) SELECT x, y, {R('v', 'v')} FROM r WHERE v IS NOT NULL")
def neighbour_mean(spark, sf):
    return rnd(focal.neighbour_mean(A.grid(spark, sf), "b1"))


@query(f"WITH {A.GRID}, l AS (SELECT x, y, (floor(b1 / 10))::INTEGER AS label FROM grid), b AS (SELECT x - 1 AS x, y, label AS other FROM l UNION ALL SELECT x, y - 1, label FROM l) SELECT label, other, count(*) AS n FROM l JOIN b USING (x, y) GROUP BY 1, 2")
def label_agreement(spark, sf):
    return focal.label_agreement(A.grid(spark, sf).select("x", "y", F.floor(F.col("b1") / 10).cast("int").alias("label")))


@query(f"WITH {A.SIGNAL}, c AS (SELECT s, d, 0.25 * lag(v) OVER w + 0.5 * v + 0.25 * lead(v) OVER w AS smooth FROM signal WINDOW w AS (PARTITION BY s ORDER BY d)) SELECT s, d::VARCHAR AS d, {R('smooth', 'smooth')} FROM c WHERE smooth IS NOT NULL")
def convolve_series(spark, sf):
    return rnd(focal.convolve_series(A.signal(spark, sf), "s", "d", "v", [0.25, 0.5, 0.25]).select("s", F.col("d").cast("string").alias("d"), "smooth"))


@query(f"WITH {A.SIGNAL}, c AS (SELECT s, d, v, (lag(v, 4) OVER w + 4 * lag(v, 2) OVER w + 6 * v + 4 * lead(v, 2) OVER w + lead(v, 4) OVER w) / 16 AS smooth FROM signal WINDOW w AS (PARTITION BY s ORDER BY d)) SELECT s, d::VARCHAR AS d, {R('smooth', 'smooth')}, {R('v - smooth', 'detail')} FROM c WHERE smooth IS NOT NULL")
def atrous_level2(spark, sf):
    return rnd(focal.atrous(A.signal(spark, sf), "s", "d", "v", 2).select("s", F.col("d").cast("string").alias("d"), "smooth", "detail"))


_PEAK = "k AS (SELECT s, d, v, v > coalesce(max(v) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '-inf'::DOUBLE) AND v > coalesce(max(v) OVER (PARTITION BY s ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '-inf'::DOUBLE) AS is_peak FROM signal)"


@query(f"WITH {A.SIGNAL}, {_PEAK} SELECT s, d::VARCHAR AS d, is_peak FROM k")
def peaks_window(spark, sf):
    return focal.peaks_window(A.signal(spark, sf), "s", "d", "v", 5).select("s", F.col("d").cast("string").alias("d"), "is_peak")


@query(
    f"WITH {A.SIGNAL}, {_PEAK}, q AS (SELECT s, date_diff('day', DATE '2020-01-01', d)::BIGINT AS pos, v FROM k WHERE is_peak), r AS (SELECT *, sum(CASE WHEN prev IS NULL OR pos - prev >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY s ORDER BY pos) AS run FROM (SELECT *, lag(pos) OVER (PARTITION BY s ORDER BY pos) AS prev FROM q)) "
    f"SELECT s, arg_min(pos, {{'a': -v, 'b': pos}}) AS pos, {R('max(v)', 'v')} FROM r GROUP BY s, run"
)
def peaks_distance(spark, sf):
    p = focal.peaks_window(A.signal(spark, sf), "s", "d", "v", 5).filter("is_peak").select("s", F.datediff("d", F.lit("2020-01-01")).cast("long").alias("pos"), "v")
    return rnd(focal.peaks_distance(p, "s", "pos", "v", 5))


_ARRAYS = "ser AS (SELECT s, list(v ORDER BY d) AS v FROM signal GROUP BY s), pr AS (SELECT a.s AS s1, b.s AS s2, a.v AS x, b.v AS y FROM ser a JOIN ser b ON a.s < b.s)"


def _rows_sql(first: str, cell: str, out: str) -> str:
    """A dynamic programme over pairs, one recursion a row of x: ``first`` gives the row above
    the first one (with a leading border cell), ``cell`` a cell from l (left), c (diagonal), u
    (above), p (value of x), q (value of y)."""
    body = cell.replace("$l", "acc[len(acc)]").replace("$c", "row[len(acc)]").replace("$u", "row[len(acc) + 1]").replace("$p", "x[i + 1]").replace("$q", "y[len(acc)]").replace("$j", "len(acc)").replace("$i", "(i + 1)")
    return f"dp(s1, s2, x, y, i, row) AS (SELECT s1, s2, x, y, 0, {first} FROM pr UNION ALL SELECT s1, s2, x, y, i + 1, list_reduce(list_concat([[$border]::DOUBLE[]], [[v]::DOUBLE[] FOR v IN y]), lambda acc, v: list_append(acc, ({body})::DOUBLE)) FROM dp WHERE i < len(x)) SELECT s1, s2, {out} FROM dp WHERE i = len(x)"


def _arrays(spark, sf) -> DataFrame:
    g = A.signal(spark, sf).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("v"))
    return g.select("s", F.transform("v", lambda x: x["v"]).alias("v"))


_INF = "'infinity'::DOUBLE"


@query(f"WITH RECURSIVE {A.SIGNAL}, {_ARRAYS}, " + _rows_sql(f"list_concat([0.0]::DOUBLE[], [{_INF} FOR v IN y])", "abs($p - $q) + least($l, $c, $u)", R("row[len(row)]", "cost")).replace("$border", _INF))
def dtw_pairs(spark, sf):
    p = series.pairs(_arrays(spark, sf), "s", "v")
    return p.select("s1", "s2", F.round(series.warp()("v1", "v2")["cost"], 6).alias("cost"))


@query(f"WITH RECURSIVE {A.SIGNAL}, {_ARRAYS}, " + _rows_sql("list_concat([0.0]::DOUBLE[], [0.0 FOR v IN y])", "abs($p - $q) + least($l, $c, $u)", R("list_min(row[2:])", "cost")).replace("$border", _INF))
def dtw_subsequence_pairs(spark, sf):
    p = series.pairs(_arrays(spark, sf), "s", "v")
    return p.select("s1", "s2", F.round(series.warp(free=True)("v1", "v2")["cost"], 6).alias("cost"))


@query(f"WITH RECURSIVE {A.SIGNAL}, {_ARRAYS.replace('list(v ORDER BY d)', 'list(floor(v / 5) ORDER BY d)')}, " + _rows_sql("list_concat([0.0]::DOUBLE[], [0.0 FOR v IN y])", "CASE WHEN $p = $q THEN $c + 1 ELSE greatest($l, $u) END", "row[len(row)]::INTEGER AS length").replace("$border", "0.0"))
def common_subsequence_pairs(spark, sf):
    p = series.pairs(_arrays(spark, sf).select("s", F.transform("v", lambda x: F.floor(x / 5).cast("double")).alias("v")), "s", "v")
    return p.select("s1", "s2", series.common()("v1", "v2")["length"].alias("length"))


@query(f"WITH RECURSIVE {A.SIGNAL}, {_ARRAYS}, " + _rows_sql("list_concat([0.0]::DOUBLE[], [0.0 FOR v IN y])", "CASE WHEN abs($p - $q) < 2.0 AND abs($i - $j) <= 3 THEN $c + 1 ELSE greatest($l, $u) END", "row[len(row)]::INTEGER AS length").replace("$border", "0.0"))
def near_subsequence_pairs(spark, sf):
    p = series.pairs(_arrays(spark, sf), "s", "v")
    return p.select("s1", "s2", series.common(2.0, 3)("v1", "v2")["length"].alias("length"))


# ------------------------------------------------------------- transforms, clusters, classes

_MOM = "m AS (SELECT avg(b1) AS m1, avg(b3) AS m3, var_samp(b1) AS s11, var_samp(b3) AS s33, covar_samp(b1, b3) AS s13 FROM pixels)"


@query(f"WITH {A.PIXELS}, {_MOM} SELECT id, b1, b3, {R('(s33 * (b1 - m1) * (b1 - m1) - 2 * s13 * (b1 - m1) * (b3 - m3) + s11 * (b3 - m3) * (b3 - m3)) / (s11 * s33 - s13 * s13)', 'rx')} FROM pixels, m")
def rx_anomaly(spark, sf):
    return rnd(classify.rx_anomaly(A.pixels(spark, sf).select("id", "b1", "b3"), ["b1", "b3"]), 6, ("b1", "b3"))


@query(f"WITH {A.PIXELS}, {_MOM}, e AS (SELECT *, (s11 + s33 + sqrt((s11 - s33) * (s11 - s33) + 4 * s13 * s13)) / 2 AS l FROM m), v AS (SELECT *, (l - s33) / sqrt((l - s33) * (l - s33) + s13 * s13) AS u1, s13 / sqrt((l - s33) * (l - s33) + s13 * s13) AS u3 FROM e) SELECT id, b1, b3, {R('(b1 - m1) * u1 + (b3 - m3) * u3', 'pc1', 5)} FROM pixels, v")
def pca_two_band(spark, sf):
    return rnd(classify.pca(A.pixels(spark, sf).select("id", "b1", "b3"), ["b1", "b3"])[0].select("id", "b1", "b3", "pc1"), 5, ("b1", "b3"))


_CLS = "c AS (SELECT cls, count(*) AS n, avg(b1) AS m1, avg(b3) AS m3, var_samp(b1) AS s11, var_samp(b3) AS s33, covar_samp(b1, b3) AS s13 FROM pixels GROUP BY cls)"


@query(
    f"WITH {A.PIXELS}, {_CLS}, s AS (SELECT p.id, p.b1, p.b3, p.cls AS label, c.cls, ln(c.n / (SELECT sum(n) FROM c)) - 0.5 * ln(s11 * s33 - s13 * s13) - (s33 * (b1 - m1) ** 2 - 2 * s13 * (b1 - m1) * (b3 - m3) + s11 * (b3 - m3) ** 2) / (s11 * s33 - s13 * s13) / 2 AS g FROM pixels p, c), "
    "b AS (SELECT id, b1, b3, label, arg_max(cls, g) AS pred FROM s GROUP BY ALL) SELECT label, pred, count(*) AS n FROM (SELECT b.* FROM b JOIN pixels p ON p.id = b.id AND p.b1 = b.b1 AND p.b3 = b.b3 AND p.cls = b.label) GROUP BY 1, 2"
)
def gaussian_ml(spark, sf):
    return classify.gaussian_ml(A.pixels(spark, sf), ["b1", "b3"], "cls").groupBy(F.col("cls").alias("label"), "pred").agg(F.count("*").alias("n"))


@query(f"WITH {A.PIXELS} SELECT " + ", ".join(R(f"(avg({b}) FILTER (WHERE cls = 'R') - avg({b}) FILTER (WHERE cls <> 'R')) / (stddev_samp({b}) FILTER (WHERE cls = 'R') + stddev_samp({b}) FILTER (WHERE cls <> 'R'))", f"w_{b}") for b in ("b1", "b3")) + " FROM pixels")
def golub_weights(spark, sf):
    return rnd(classify.golub(A.pixels(spark, sf), ["b1", "b3"], F.col("cls") == "R"))


@query(
    f"WITH {A.PIXELS}, c AS (SELECT cls, count(*) AS n, avg(b1) AS m1, avg(b3) AS m3, var_samp(b1) AS s11, var_samp(b3) AS s33, covar_samp(b1, b3) AS s13 FROM pixels GROUP BY cls), "
    "w AS (SELECT sum(n) AS n, sum(s11 * (n - 1)) / (sum(n) - count(*)) AS a, sum(s33 * (n - 1)) / (sum(n) - count(*)) AS b, sum(s13 * (n - 1)) / (sum(n) - count(*)) AS d FROM c), "
    "k AS (SELECT cls, (b * m1 - d * m3) / (a * b - d * d) AS w1, (a * m3 - d * m1) / (a * b - d * d) AS w3, m1, m3, ln(c.n / w.n) AS p FROM c, w), "
    "g AS (SELECT p.rowid AS i, p.cls AS label, k.cls, k.w1 * (b1 - m1 / 2) + k.w3 * (b3 - m3 / 2) + k.p AS g FROM (SELECT *, row_number() OVER () AS rowid FROM pixels) p, k) "
    "SELECT label AS cls, pred, count(*) AS n FROM (SELECT i, label, arg_max(cls, g) AS pred FROM g GROUP BY i, label) GROUP BY 1, 2"
)
def lda_classifier(spark, sf):
    return classify.lda(A.pixels(spark, sf), ["b1", "b3"], "cls").groupBy("cls", "pred").agg(F.count("*").alias("n"))


@query(
    "WITH t AS (SELECT a.vec_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id), "
    "v AS (SELECT vec_id, label, count(*) AS n FROM t WHERE r <= 5 GROUP BY 1, 2), w AS (SELECT *, max(n) OVER (PARTITION BY vec_id) AS top FROM v) SELECT vec_id, CASE WHEN count(*) = 1 THEN max(label) ELSE 0 END AS pred FROM w WHERE n = top GROUP BY vec_id"
)
def knn(spark, sf):
    e = A.table(spark, sf, "embeddings")
    return classify.knn(e, e, "vec_id", "embedding", "label", 5)


def kmeans_sql(rounds: int, start: str, source: str, b1: str = "b1", b3: str = "b3") -> str:
    """Lloyd's rounds written out; ties go to the first centre."""
    parts = [f"c0 AS ({start})"]
    label = lambda c: f"(SELECT p.{b1}, p.{b3}, arg_min(c.k, {{'d': (p.{b1} - c.x) ** 2 + (p.{b3} - c.y) ** 2, 'k': c.k}}) AS k FROM {source} p, {c} c GROUP BY p.rid, p.{b1}, p.{b3})"
    for t in range(1, rounds + 1):
        parts.append(f"c{t} AS MATERIALIZED (SELECT k, avg({b1}) AS x, avg({b3}) AS y FROM {label(f'c{t - 1}')} GROUP BY k)")
    return f"{', '.join(parts)}, final AS {label(f'c{rounds}')}"


@query(
    f"WITH {A.PIXELS}, px AS (SELECT *, row_number() OVER () AS rid FROM pixels), {kmeans_sql(10, 'SELECT * FROM (VALUES (1, 10.0::DOUBLE, 0.02::DOUBLE), (2, 25.0, 0.05), (3, 40.0, 0.08)) v(k, x, y)', 'px')} "
    f"SELECT k AS cluster, count(*) AS n, {R('avg(b1)', 'b1', 4)}, {R('avg(b3)', 'b3')} FROM final GROUP BY k"
)
def kmeans_ten_rounds(spark, sf):
    out, _, _ = cluster.kmeans(A.pixels(spark, sf), ["b1", "b3"], [[10, 0.02], [25, 0.05], [40, 0.08]], 10)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("b1"), 4).alias("b1"), F.round(F.avg("b3"), 6).alias("b3"))


# ------------------------------------------------------------- accuracy, ranks

_PRED = "pred AS (SELECT l.doc_id, l.quality AS label, (d.n_chars > 500)::INTEGER AS p1, (d.n_chars > 1500)::INTEGER AS p2, d.n_chars::DOUBLE AS score FROM labels l JOIN documents d USING (doc_id))"


def _pred(spark, sf) -> DataFrame:
    d = A.table(spark, sf, "documents").select("doc_id", "n_chars")
    x: Column = F.col("n_chars")
    return A.table(spark, sf, "labels").join(d, "doc_id").select("doc_id", F.col("quality").alias("label"), (x > 500).cast("int").alias("p1"), (x > 1500).cast("int").alias("p2"), x.cast("double").alias("score"))


@query(f"WITH {_PRED} SELECT p1 AS pred, label, count(*) AS n FROM pred GROUP BY CUBE (p1, label)")
def contingency(spark, sf):
    return metrics.contingency(_pred(spark, sf), "p1", "label")


@query(
    f"WITH {_PRED}, t AS (SELECT p1 AS p, label AS l, count(*)::DOUBLE AS c FROM pred GROUP BY 1, 2), n AS (SELECT sum(c) AS n FROM t), r AS (SELECT p, sum(c) AS r FROM t GROUP BY p), k AS (SELECT l, sum(c) AS k FROM t GROUP BY l), "
    "q AS (SELECT max(n) AS n, sum(CASE WHEN t.p = t.l THEN c ELSE 0 END) / max(n) AS t1, (SELECT sum(r * k) FROM r JOIN k ON r.p = k.l) / max(n) ** 2 AS t2, sum(CASE WHEN t.p = t.l THEN c * (r.r + k.k) ELSE 0 END) / max(n) ** 2 AS t3, sum(c * (coalesce(kp.k, 0) + coalesce(rl.r, 0)) ** 2) / max(n) ** 3 AS t4 "
    "FROM t JOIN r ON t.p = r.p JOIN k ON t.l = k.l LEFT JOIN r rl ON rl.p = t.l LEFT JOIN k kp ON kp.l = t.p, n) "
    f"SELECT {R('t1', 'accuracy')}, {R('(t1 - t2) / (1 - t2)', 'kappa')}, {R('(t1 * (1 - t1) / (1 - t2) ** 2 + 2 * (1 - t1) * (2 * t1 * t2 - t3) / (1 - t2) ** 3 + (1 - t1) ** 2 * (t4 - 4 * t2 ** 2) / (1 - t2) ** 4) / n', 'kappa_var', 8)} FROM q"
)
def kappa(spark, sf):
    return metrics.kappa(_pred(spark, sf), "p1", "label").select(F.round("accuracy", 6).alias("accuracy"), F.round("kappa", 6).alias("kappa"), F.round("kappa_var", 8).alias("kappa_var"))


@query(f"WITH {_PRED}, t AS (SELECT count(*) FILTER (WHERE p1 <> label AND p2 = label) AS n01, count(*) FILTER (WHERE p1 = label AND p2 <> label) AS n10 FROM pred), s AS (SELECT *, CASE WHEN n01 + n10 > 0 THEN (n01 - n10) ** 2 / (n01 + n10) ELSE 0.0 END AS x FROM t) SELECT n01, n10, {R('x', 'statistic')}, {R('1 - ' + chi2_cdf_sql('x', 1), 'p_value')} FROM s")
def mcnemar(spark, sf):
    return rnd(metrics.mcnemar(_pred(spark, sf), "p1", "p2", "label"))


@query(
    f"WITH {_PRED}, t AS (SELECT count(*) FILTER (WHERE label = 1 AND p1 = 1) AS tp, count(*) FILTER (WHERE label = 1 AND p1 = 0) AS fn, count(*) FILTER (WHERE label = 0 AND p1 = 1) AS fp, count(*) FILTER (WHERE label = 0 AND p1 = 0) AS tn FROM pred) SELECT "
    + ", ".join(R(f"coalesce({a}::DOUBLE / nullif({b}, 0), 0.0)", c) for a, b, c in (("(fn + fp)", "tp + fn + fp + tn", "error"), ("(tp + tn)", "tp + fn + fp + tn", "accuracy"), ("fn", "tp + fn", "error_p"), ("fp", "tn + fp", "error_n"), ("tp", "tp + fn", "sensitivity"), ("tn", "tn + fp", "specificity"), ("tp", "tp + fp", "ppv"), ("tn", "tn + fn", "npv")))
    + f", {R('(tp * tn - fp * fn) / coalesce(nullif(sqrt((tp + fn)::DOUBLE * (tp + fp) * (tn + fp) * (tn + fn)), 0), 1)', 'mcc')} FROM t"
)
def binary_metrics(spark, sf):
    return rnd(metrics.binary_metrics(_pred(spark, sf), F.col("label") == 1, F.col("p1") == 1))


@query(f"WITH {_PRED} SELECT {R('sum((a.score > b.score)::INTEGER) / count(*)', 'auc')} FROM pred a, pred b WHERE a.label = 1 AND b.label = 0")
def auc(spark, sf):
    return rnd(metrics.auc(_pred(spark, sf), F.col("label") == 1, F.col("score")))


@query(f"WITH {A.PIXELS} SELECT {R('avg((b3 - b4) * (b3 - b4))', 'mse')}, {R('1 - avg((b3 - b4) * (b3 - b4)) / var_pop(b3)', 'r2')}, {R('corr(b3, b4) ** 2', 'r2_corr')} FROM pixels")
def regression_metrics(spark, sf):
    return rnd(metrics.regression_metrics(A.pixels(spark, sf), "b3", "b4"))


@query("SELECT doc_id, quality, ((row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 2654435761) % 1000003, doc_id) - 1) % 10)::INTEGER AS fold FROM labels")
def stratified_folds(spark, sf):
    return metrics.stratified_folds(A.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 10)


_LISTS = "lists AS (SELECT user_id AS list_id, event_type AS id, (row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) - 1)::BIGINT AS pos FROM events GROUP BY 1, 2)"


def _lists(spark, sf) -> DataFrame:
    c = A.table(spark, sf, "events").groupBy(F.col("user_id").alias("list_id"), F.col("event_type").alias("id")).agg(F.count("*").alias("c"))
    return c.select("list_id", "id", (F.row_number().over(Window.partitionBy("list_id").orderBy(F.desc("c"), "id")) - 1).cast("long").alias("pos"))


@query(f"WITH {_LISTS}, t AS (SELECT id, count(*) FILTER (WHERE pos < 3) AS extractions, coalesce(avg(pos) FILTER (WHERE pos < 3), 0.0) AS mean_pos FROM lists GROUP BY id) SELECT id, extractions, {R('mean_pos', 'mean_pos')}, row_number() OVER (ORDER BY extractions DESC, mean_pos, id)::INTEGER AS rank FROM t")
def borda_count(spark, sf):
    return rnd(metrics.borda(_lists(spark, sf), 3))


#: Positions of five items count as 1, 2, 3, 4, 4; the expectation is the mean over all pairs of
#: them, five times.
_EXPECTED = "(WITH q(v) AS (VALUES (1.0), (2.0), (3.0), (4.0), (4.0)) SELECT sum(abs(a.v - b.v) / (a.v + b.v)) / 5 FROM q a, q b)"


@query(f"WITH {_LISTS}, d AS (SELECT sum(abs(least(a.pos + 1, 4) - least(b.pos + 1, 4)) / (least(a.pos + 1, 4) + least(b.pos + 1, 4))) AS d FROM lists a JOIN lists b ON a.id = b.id AND a.list_id < b.list_id), n AS (SELECT count(DISTINCT list_id) AS n FROM lists) SELECT {R(f'd / (n * (n - 1) / 2) / {_EXPECTED}', 'stability')} FROM d, n")
def canberra_stability(spark, sf):
    return rnd(metrics.canberra_stability(_lists(spark, sf), 3, 5))


@query("SELECT o_orderkey, o_orderdate, round(o_totalprice, 2) AS o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice, o_orderkey LIMIT 5")
def scene_pick(spark, sf):
    o = A.table(spark, sf, "orders").filter((F.col("o_orderdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("o_orderpriority") == "1-URGENT"))
    return o.orderBy("o_totalprice", "o_orderkey").limit(5).select("o_orderkey", "o_orderdate", F.round("o_totalprice", 2).alias("o_totalprice"))


# ------------------------------------------------------------- composites, coordinates, separability


@query(f"WITH {A.SERIES} SELECT pix, {R('avg(v)', 'mean_v')}, {R('max(v)', 'max_v')} FROM series GROUP BY pix")
def temporal_composite(spark, sf):
    return rnd(A.series(spark, sf).groupBy("pix").agg(F.avg("v").alias("mean_v"), F.max("v").alias("max_v")))


@query(f"WITH {A.GRID} SELECT x, y, {R('500000 + 28.5 * x::DOUBLE + 1.5 * y::DOUBLE', 'px')}, {R('5600000 + 1.5 * x::DOUBLE - 28.5 * y::DOUBLE', 'py')}, {R('x::DOUBLE', 'back_x')}, {R('y::DOUBLE', 'back_y')} FROM grid")
def map_coordinates(spark, sf):
    gt = (500000.0, 28.5, 1.5, 5600000.0, 1.5, -28.5)
    rows = A.grid(spark, sf).select("x", "y")
    px, py = local.affine(F.col("x"), F.col("y"), gt)
    rows = rows.withColumn("px", px).withColumn("py", py)
    bx, by = local.affine_inverse(F.col("px"), F.col("py"), gt)
    return rnd(rows.withColumn("back_x", bx).withColumn("back_y", by))


@query(f"WITH {A.GRID} SELECT x, y, {R('ln(b1 + b3 + b4 + 0.001)', 'span')} FROM grid")
def log_span(spark, sf):
    return rnd(A.grid(spark, sf).select("x", "y", local.log_span(F.col("b1"), F.col("b3"), F.col("b4")).alias("span")))


@query(
    f"WITH {A.PIXELS}, m AS (SELECT cls, avg(b1) AS m, var_samp(b1) AS v FROM pixels GROUP BY cls), d AS (SELECT a.cls AS c1, b.cls AS c2, (a.m - b.m) * (a.m - b.m) / (4 * (a.v + b.v)) + 0.5 * ln((a.v + b.v) / (2 * sqrt(a.v * b.v))) AS dist FROM m a JOIN m b ON a.cls < b.cls) "
    f"SELECT c1, c2, {R('dist', 'bhattacharyya')}, {R('2 * (1 - exp(-dist))', 'jm')} FROM d"
)
def jeffries_matusita(spark, sf):
    return rnd(moments.jeffries_matusita(A.pixels(spark, sf), "b1", "cls"))


from . import more  # noqa: E402, F401 - registers the rest
