"""Further registered queries: radar matrices, transforms, clusters, classifiers, regressions,
images as a whole, series, sampling.  Kept apart from ``registry`` for size alone."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cdf import chi2_cdf_sql
from ..operators import change, classify, cluster, fits, focal, learn, local, metrics, moments, radar, regress, sampling, series, transforms
from ..sources import adapters as A
from .registry import _K, _N, _PRED, R, _omnibus_sql, _pred, _FOLD, kmeans_sql, query, rnd, rnd_scaled  # noqa: F401

# ------------------------------------------------------------- radar matrices

#: Matrices per user and bucket, from the mean value: positive definite in any case.
_POL = "pol AS (SELECT pix, t, abs(v) + 1 AS c1, 0.3 * sin(v) AS c2, 0.2 * cos(v) AS c3, 0.5 * abs(v) + 2 AS c4, 0.2 * abs(v) + 0.5 AS c5 FROM series)"


def _arr_sql(bands: list[str]) -> str:
    return "arr AS (SELECT pix, " + ", ".join(f"list({b} ORDER BY t) AS {b}" for b in bands) + " FROM pol GROUP BY pix HAVING count(*) = 5)"


def _pol(spark, sf, bands: list[str]) -> DataFrame:
    v = F.col("v")
    s = A.series(spark, sf).select("pix", "t", (F.abs(v) + 1).alias("c1"), (0.3 * F.sin(v)).alias("c2"), (0.2 * F.cos(v)).alias("c3"), (0.5 * F.abs(v) + 2).alias("c4"), (0.2 * F.abs(v) + 0.5).alias("c5"))
    return change.series_arrays(s, _K, value=bands)


def _factors(name: str, bands: list[str]) -> None:
    def run(spark, sf):
        return rnd(change.omnibus(_pol(spark, sf, bands), _K, _N, bands=bands))

    run.__name__ = name
    query(f"WITH {A.SERIES}, {_POL}, {_arr_sql(bands)}, {_omnibus_sql(bands)} SELECT pix, ell, j, {R('ln_r', 'ln_r')}, {R('p', 'p')} FROM tests")(run)


_factors("omnibus_dual", ["c1", "c2", "c3", "c4"])
_factors("omnibus_dual_diagonal", ["c1", "c4"])
_factors("omnibus_quad_diagonal", ["c1", "c4", "c5"])

_FULL = ["c1", "c2", "c3", "c4"]
#: f, rho and omega2 of the statistic of m = 6 - ell images, p = 2.
_Q = (
    "qs AS (SELECT pix, ell, 6 - ell AS m, sum(ln_r) AS ln_q FROM tests GROUP BY pix, ell), "
    f"qr AS (SELECT *, 1 - 7 * (m / {_N} - 1 / ({_N} * m)) / (12.0 * (m - 1)) AS rho FROM qs), "
    f"qw AS (SELECT *, 12 * (m / {_N * _N} - 1 / ({_N * _N} * m * m)) / (24 * rho * rho) - 4 * (m - 1) * (1 - 1 / rho) * (1 - 1 / rho) / 4 AS w, -2 * rho * ln_q AS z FROM qr), "
    "qv AS (SELECT pix, ell, 1 - CASE ell "
    + " ".join(f"WHEN {e} THEN (1 - w) * {chi2_cdf_sql('z', 4 * (5 - e))} + w * {chi2_cdf_sql('z', 4 * (5 - e) + 4)}" for e in range(1, _K))
    + " END AS q FROM qw)"
)
_MAPS = f"{A.SERIES}, {_POL}, {_arr_sql(_FULL)}, {_omnibus_sql(_FULL)}, {_Q}, flags AS (SELECT t.*, p <= 0.05 AND q <= 0.05 AS low FROM tests t JOIN qv USING (pix, ell)), {_FOLD}"


def _maps(spark, sf) -> DataFrame:
    tests = change.omnibus(_pol(spark, sf, _FULL), _K, _N, bands=_FULL)
    return change.change_maps(change.with_q(tests, _K, _N, 4), 0.05, k=_K)


@query(f"WITH RECURSIVE {_MAPS} SELECT pix, cmap, smap, fmap, array_to_string(bmap, ',') AS bmap FROM maps")
def omnibus_conjunction_maps(spark, sf):
    return _maps(spark, sf).withColumn("bmap", F.array_join(F.transform("bmap", lambda x: x.cast("string")), ","))


@query(f"WITH RECURSIVE {_MAPS}, u AS (SELECT unnest(range(1, {_K})) AS interval, unnest(bmap) AS b FROM maps) SELECT interval::INTEGER AS interval, sum(b // 255)::BIGINT AS n FROM u GROUP BY 1")
def changes_per_interval(spark, sf):
    return change.changes_per_interval(_maps(spark, sf))


_DIFF = "x.c1 - a.m1 AS d1, x.c2 - a.m2 AS d2, x.c3 - a.m3 AS d3, x.c4 - a.m4 AS d4"


@query(
    f"WITH RECURSIVE {_MAPS}, px AS (SELECT arr.pix, c1, c2, c3, c4, bmap FROM arr JOIN maps USING (pix)), "
    "w(pix, i, r, m1, m2, m3, m4, d) AS (SELECT pix, 1::BIGINT, 1.0::DOUBLE, c1[1], c2[1], c3[1], c4[1], []::INTEGER[] FROM px UNION ALL "
    "SELECT pix, i + 1, CASE WHEN hit THEN 1.0 ELSE r + 1 END, CASE WHEN hit THEN v1 ELSE m1 + (v1 - m1) / (r + 1) END, CASE WHEN hit THEN v2 ELSE m2 + (v2 - m2) / (r + 1) END, CASE WHEN hit THEN v3 ELSE m3 + (v3 - m3) / (r + 1) END, CASE WHEN hit THEN v4 ELSE m4 + (v4 - m4) / (r + 1) END, "
    "list_append(d, CASE WHEN NOT hit THEN 0 WHEN tr - disc > 0 THEN 1 WHEN tr + disc < 0 THEN 2 ELSE 3 END) FROM (SELECT *, v1 - m1 + v4 - m4 AS tr, sqrt((v1 - m1 - v4 + m4) ** 2 + 4 * ((v2 - m2) ** 2 + (v3 - m3) ** 2)) AS disc FROM "
    f"(SELECT w.*, c1[i + 1] AS v1, c2[i + 1] AS v2, c3[i + 1] AS v3, c4[i + 1] AS v4, bmap[i] > 0 AS hit FROM w JOIN px USING (pix) WHERE i < {_K}))) SELECT pix, array_to_string(d, ',') AS dmap FROM w WHERE i = {_K}"
)
def directional_change(spark, sf):
    out = change.directional_change(_pol(spark, sf, _FULL), _maps(spark, sf), _FULL, _K)
    return out.select("pix", F.array_join(F.transform("dmap", lambda x: x.cast("string")), ",").alias("dmap"))


@query(
    "WITH RECURSIVE t(i, n) AS (SELECT 21, 2.1::DOUBLE UNION ALL SELECT i + 1, (i + 1) / 10.0 FROM t WHERE i < 799), "
    "d AS (SELECT n, [ln(n - k + 12) - 0.5 / (n - k + 12) - 1 / (12 * (n - k + 12) ** 2) + 1 / (120 * (n - k + 12) ** 4) - 1 / (252 * (n - k + 12) ** 6) - list_sum([1 / (n - k + j) FOR j IN range(0, 12)]) FOR k IN range(0, 3)] AS p FROM t) "
    f"SELECT n, {R('ln(n) - p[1]', 'p1')}, {R('2 * ln(n) - p[1] - p[2]', 'p2')}, {R('3 * ln(n) - p[1] - p[2] - p[3]', 'p3')} FROM d"
)
def looks_lookup(spark, sf):
    return rnd(radar.looks_lookup(spark))


_W7 = "w AS (SELECT a.x, a.y, list(b.v ORDER BY b.y, b.x) AS w FROM img a JOIN img b ON b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 GROUP BY a.x, a.y HAVING count(*) = 49)"
_IMG = "img AS (SELECT x, y, b1 + 1 AS v FROM grid WHERE x BETWEEN 20 AND 69 AND y BETWEEN 10 AND 59)"


def _image(spark, sf, in_order: bool = False) -> DataFrame:
    return A.grid(spark, sf, in_order).filter("x between 20 and 69 and y between 10 and 59").select("x", "y", (F.col("b1") + 1).alias("v"))


def _halves_sql() -> list[list[int]]:
    """Places (from 1) of the eight half windows: three columns or a triangle, turned."""
    turn = lambda s: {(6 - c, r) for r, c in s}
    out, a, b = [], {(r, c) for r in range(7) for c in range(3)}, {(r, c) for r in range(7) for c in range(r)}
    for _ in range(4):
        out += [sorted(7 * r + c + 1 for r, c in s) for s in (a, b)]
        a, b = turn(a), turn(b)
    return out


def _chosen_sql() -> str:
    z = lambda i, j: f"w[{21 * i + 3 * j + 1}]"
    e = [f"{z(0, 2)} + {z(1, 2)} + {z(2, 2)} - {z(0, 0)} - {z(1, 0)} - {z(2, 0)}", f"{z(0, 1)} + {z(0, 2)} + {z(1, 2)} - {z(1, 0)} - {z(2, 0)} - {z(2, 1)}", f"{z(0, 0)} + {z(0, 1)} + {z(0, 2)} - {z(2, 0)} - {z(2, 1)} - {z(2, 2)}", f"{z(0, 0)} + {z(0, 1)} + {z(1, 0)} - {z(1, 2)} - {z(2, 1)} - {z(2, 2)}"]
    m = z(1, 1)
    pick = [(z(1, 0), z(1, 2), 0, 4), (z(2, 0), z(0, 2), 1, 5), (z(0, 1), z(2, 1), 6, 2), (z(0, 0), z(2, 2), 7, 3)]
    which = "CASE list_position(e, list_max(e)) " + " ".join(f"WHEN {i + 1} THEN CASE WHEN abs({m} - {a}) < abs({m} - {b}) THEN {p + 1} ELSE {q + 1} END" for i, (a, b, p, q) in enumerate(pick)) + " END"
    halves = "[" + ", ".join(str(h) for h in _halves_sql()) + "]"
    return f"e AS (SELECT *, [{', '.join(e)}] AS e FROM w), h AS (SELECT *, [w[i] FOR i IN ({halves})[{which}]] AS h FROM e), s AS (SELECT x, y, w[25] AS g, list_avg(h) AS mu, list_var_pop(h) AS var FROM h)"


@query(
    f"WITH {A.GRID}, {_IMG}, {_W7}, {_chosen_sql()}, a AS (SELECT *, abs((1 + 1 / 4.0) / (var / (mu * mu) - 1 / 4.0)) AS alpha FROM s WHERE var > 0), f AS (SELECT x, y, (mu * (alpha - 5) + sqrt(4 * g * 4.0 * alpha * mu + (mu * (alpha - 5)) ** 2)) / (2 * alpha) AS f FROM a) "
    f"SELECT img.x, img.y, {R('coalesce(f, v)', 'v', 4)} FROM img LEFT JOIN f USING (x, y)"
)
def gamma_map_filter(spark, sf):
    return rnd(radar.gamma_map(_image(spark, sf), ["v"], 4.0), 4)


@query(
    f"WITH {A.GRID}, {_IMG}, {_W7}, {_chosen_sql()}, f AS (SELECT x, y, mu + CASE WHEN var > 0 THEN greatest((1 - mu * mu / (var * 4.0)) / (1 + 1 / 4.0), 0) ELSE 0 END * (g - mu) AS f FROM s) "
    f"SELECT img.x, img.y, {R('coalesce(f, v)', 'v')} FROM img LEFT JOIN f USING (x, y)"
)
def mmse_filter(spark, sf):
    return rnd_scaled(radar.mmse(_image(spark, sf, in_order=True), ["v"], 4.0))  # half windows by equal edges


@query(
    f"WITH RECURSIVE {A.GRID}, {_IMG}, {_W7}, t(i, n) AS (SELECT 1, 0.1::DOUBLE UNION ALL SELECT i + 1, (i + 1) / 10.0 FROM t WHERE i < 799), "
    "l AS (SELECT n, ln(n) - (ln(n + 12) - 0.5 / (n + 12) - 1 / (12 * (n + 12) ** 2) + 1 / (120 * (n + 12) ** 4) - 1 / (252 * (n + 12) ** 6) - list_sum([1 / (n + j) FOR j IN range(0, 12)])) AS f FROM t), "
    "a AS (SELECT x, y, list_avg([ln(u) FOR u IN w]) - ln(list_avg(w)) AS a FROM w) SELECT x, y, coalesce(min(n) FILTER (WHERE a + f <= 0), 0.0) AS enl FROM a, l GROUP BY x, y"
)
def equivalent_looks(spark, sf):
    return radar.equivalent_looks(_image(spark, sf), ["v"])


# ------------------------------------------------------------- normalization, tests, statistics

_KEPT = f"{A.PAIR}, m AS (SELECT avg(a1) AS mx, avg(c1) AS my, stddev_samp(a1) AS sx, stddev_samp(c1) AS sy, corr(a1, c1) AS r FROM pair), z AS (SELECT p.*, ((a1 - mx) / sx - sign(r) * (c1 - my) / sy) ** 2 / (2 * (1 - abs(r))) AS chi2 FROM pair p, m), kept AS (SELECT *, (id * 2654435761) % 1000 < 667 AS train FROM z WHERE 1 - {chi2_cdf_sql('chi2', 1)} > 0.2)"
_FITS = (
    "st AS (SELECT 'a1' AS band, a1 AS y, c1 AS x, train FROM kept UNION ALL SELECT 'a2', a2, c2, train FROM kept UNION ALL SELECT 'a3', a3, c3, train FROM kept), "
    "fm AS (SELECT band, avg(y) AS my, avg(x) AS mx, var_samp(y) AS syy, var_samp(x) AS sxx, covar_samp(x, y) AS sxy, corr(x, y) AS r FROM st WHERE train GROUP BY band), "
    "ft AS (SELECT band, r, my, mx, (sxx - syy + sqrt((sxx - syy) * (sxx - syy) + 4 * sxy * sxy)) / (2 * sxy) AS slope FROM fm)"
)


def _kept(spark, sf) -> tuple[DataFrame, list]:
    mad = change.change_map(change.mad_single_band(A.pair(spark, sf), "a1", "c1"), 1)
    return mad, [("a1", "c1"), ("a2", "c2"), ("a3", "c3")]


def _fits(spark, sf) -> DataFrame:
    mad, bands = _kept(spark, sf)
    return change.normalization_fits(mad, bands, F.col("p_nochange") > 0.2, F.pmod(F.col("id") * 2654435761, F.lit(1000)) < 667)


@query(
    f"WITH {_KEPT}, {_FITS}, h AS (SELECT band, slope, r, mx - slope * my AS intercept, x, mx - slope * my + slope * y AS z FROM st JOIN ft USING (band) WHERE NOT train) "
    f"SELECT band, {R('max(slope)', 'slope', 4)}, {R('max(r)', 'r')}, count(*) AS n_test, {R('(avg(x) - avg(z)) / sqrt((var_samp(x) + var_samp(z)) / count(*))', 't', 4)}, {R('greatest(var_samp(x), var_samp(z)) / least(var_samp(x), var_samp(z))', 'f', 4)} FROM h GROUP BY band"
)
def normalization_fits(spark, sf):
    f = _fits(spark, sf)
    return f.select("band", F.round("slope", 4).alias("slope"), F.round("r", 6).alias("r"), "n_test", F.round("t", 4).alias("t"), F.round("f", 4).alias("f"))


@query(f"WITH {_KEPT}, {_FITS} SELECT id, " + ", ".join(R(f"(SELECT mx - slope * my FROM ft WHERE band = '{b}') + (SELECT slope FROM ft WHERE band = '{b}') * {b}", b, 2) for b in ("a1", "a3")) + " FROM pair")
def normalized_scene(spark, sf):
    out = change.normalized(A.pair(spark, sf).select("id", "a1", "a3"), ["a1", "a3"], _fits(spark, sf))
    return rnd(out, 2)


@query(
    f"WITH {A.PAIR}, {_KEPT.split(', m AS', 1)[0].replace(A.PAIR, 'm0 AS (SELECT 1)')}, m AS (SELECT avg(a1) AS mx, avg(c1) AS my, stddev_samp(a1) AS sx, stddev_samp(c1) AS sy, corr(a1, c1) AS r FROM pair), z AS (SELECT id, a1, ((a1 - mx) / sx - sign(r) * (c1 - my) / sy) AS mad, r FROM pair, m), "
    f"p AS (SELECT id, mad, 1 - {chi2_cdf_sql('mad * mad / (2 * (1 - abs(r)))', 1)} AS p FROM z) SELECT id, {R('CASE WHEN p <= 0.95 THEN mad ELSE 0 END', 'mad')} FROM p"
)
def masked_change(spark, sf):
    out = change.change_map(change.mad_single_band(A.pair(spark, sf), "a1", "c1"), 1, zero=("mad",))
    return rnd(out.select("id", "mad"))


@query(f"WITH {A.PIXELS}, m AS (SELECT avg(b1) AS m1, avg(b4) AS m4, sum(b3 + 0.5) AS sw, sum((b3 + 0.5) * b1) / sum(b3 + 0.5) AS w1, sum((b3 + 0.5) * b4) / sum(b3 + 0.5) AS w4 FROM pixels) SELECT {R('max(sw)', 'sum_w')}, {R('max(w1)', 'mean_b1')}, {R('max(w4)', 'mean_b4')}, {R('sum((b3 + 0.5) * (b1 - w1) * (b1 - w1)) / max(sw)', 'cov_b1_b1')}, {R('sum((b3 + 0.5) * (b1 - w1) * (b4 - w4)) / max(sw)', 'cov_b1_b4')}, {R('sum((b3 + 0.5) * (b4 - w4) * (b4 - w4)) / max(sw)', 'cov_b4_b4')} FROM pixels, m")
def population_covariance(spark, sf):
    return rnd(moments.weighted_moments(A.pixels(spark, sf), ["b1", "b4"], F.col("b3") + 0.5, ddof=0.0))


@query(f"SELECT count(*) AS n, {R('avg(value)', 'mean')}, {R('avg(value) - 1.959963984540054 * stddev_samp(value) / sqrt(count(*))', 'low')}, {R('avg(value) + 1.959963984540054 * stddev_samp(value) / sqrt(count(*))', 'high')} FROM events")
def mean_interval(spark, sf):
    return rnd(sampling.mean_interval(A.table(spark, sf, "events"), "value").select("n", "mean", "low", "high"))


@query(f"WITH t AS (SELECT var_pop(value) FILTER (WHERE event_type = 'click') AS v0, var_pop(value) FILTER (WHERE event_type <> 'click') AS v1 FROM events) SELECT {R('greatest(v0, v1) / least(v0, v1)', 'f')} FROM t")
def variance_ratio(spark, sf):
    return rnd(sampling.variance_test(A.table(spark, sf, "events"), "value", F.col("event_type") == "click").select("f"))


_U = "((id * 2654435761 + b * 40503 * 65537) % 1000003) / 1000003.0"


@query(
    f"WITH e AS (SELECT event_id AS id, value FROM events), r AS (SELECT b, value, {_U} AS u FROM e, range(0, 100) t(b)), k AS (SELECT b, value, list_count([c FOR c IN [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253] IF u >= c]) AS k FROM r), "
    f"m AS (SELECT sum(k * value) / sum(k) AS m FROM k GROUP BY b), s AS (SELECT list(m ORDER BY m) AS m FROM m) SELECT {R('m[3]', 'low', 4)}, {R('m[98]', 'high', 4)} FROM s"
)
def bootstrap_interval(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("event_id").alias("id"), "value")
    return rnd(sampling.bootstrap_mean(e, "id", "value", 100, 0.05), 4)


@query("SELECT event_id, value FROM events ORDER BY (event_id * 2654435761) % 1000003, event_id LIMIT 100")
def hash_sample(spark, sf):
    return cluster.hash_sample(A.table(spark, sf, "events").select("event_id", "value"), "event_id", 100)


@query(f"SELECT n_nationkey, {R("coalesce(avg(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY'), avg(c_acctbal), (SELECT avg(c_acctbal) FROM customer))", 'mean')} FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def region_mean(spark, sf):
    c, n = A.table(spark, sf, "customer"), A.table(spark, sf, "nation")
    return rnd(sampling.region_mean(n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left"), ["n_nationkey"], "c_acctbal", F.col("c_mktsegment") == "MACHINERY"))


@query("SELECT o_orderpriority, count(*) AS n, list(o_orderkey ORDER BY o_orderdate, o_orderkey)[1:3]::VARCHAR AS first_keys, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses FROM orders GROUP BY 1")
def collection_arrays(spark, sf):
    o = A.table(spark, sf, "orders")
    out = sampling.collection_arrays(o, ["o_orderpriority"], "o_orderkey", "o_orderdate", "o_orderstatus", 3)
    return out.select("o_orderpriority", "n", F.concat(F.lit("["), F.array_join(F.transform("first_keys", lambda x: x.cast("string")), ", "), F.lit("]")).alias("first_keys"), F.array_join("statuses", ",").alias("statuses"))


@query("SELECT event_id, ((event_id * 2654435761 + 7) % 1000003) / 1000003.0 AS random, CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS label FROM events")
def random_column_remap(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", sampling.random_column(F.col("event_id"), 7).alias("random"), sampling.remap(F.col("event_type"), {"click": 1, "view": 2}, 0).alias("label"))


@query(f"WITH {A.GRID} SELECT count(*) AS n, {R('avg(b1)', 'mean')}, {R('var_samp(b1)', 'var', 4)} FROM grid WHERE (x - 50) ** 2 + (y - 40) ** 2 <= 400")
def masked_statistics(spark, sf):
    g = A.grid(spark, sf).filter((F.col("x") - 50) ** 2 + (F.col("y") - 40) ** 2 <= 400)
    return g.agg(F.count("*").alias("n"), F.round(F.avg("b1"), 6).alias("mean"), F.round(F.var_samp("b1"), 4).alias("var"))


@query("WITH RECURSIVE k(i) AS (SELECT 0 UNION ALL SELECT i + 1 FROM k WHERE i < 20) SELECT i AS k, round(exp(lgamma(21) - lgamma(i + 1) - lgamma(21 - i) + i * ln(0.3) + (20 - i) * ln(0.7)), 9) AS pmf FROM k")
def binomial_distribution(spark, sf):
    return sampling.binomial_pmf(spark, 20, 0.3).select("k", F.round("pmf", 9).alias("pmf"))


@query("SELECT doc_id, quality, (row_number() OVER (PARTITION BY quality ORDER BY (doc_id * 2654435761) % 1000003, doc_id) - 1) < floor(count(*) OVER (PARTITION BY quality) * 0.3) AS test FROM labels")
def random_split(spark, sf):
    return metrics.random_split(A.table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "quality", 0.3)


@query(f"WITH {_PRED}, p AS (SELECT p1 AS cls, count(*) AS n_pred, sum((p1 = label)::INTEGER) AS h FROM pred GROUP BY 1), l AS (SELECT label AS cls, count(*) AS n_label FROM pred GROUP BY 1) SELECT cls, coalesce(n_pred, 0)::BIGINT AS n_pred, coalesce(n_label, 0)::BIGINT AS n_label, coalesce(h, 0)::BIGINT AS n_hit, {R('h / n_pred', 'user_accuracy')}, {R('coalesce(h, 0) / n_label', 'producer_accuracy')} FROM p FULL JOIN l USING (cls)")
def class_accuracies(spark, sf):
    return rnd(metrics.class_accuracies(_pred(spark, sf), "p1", "label"))


@query(f"WITH {_PRED}, t AS (SELECT count(*)::DOUBLE AS n, sum((p1 <> label)::INTEGER)::DOUBLE AS y FROM pred) SELECT {R('y / n', 'rate')}, {R('sqrt(y * (n - y) / (n * n * n))', 'sd')}, {R('(y + 1.921 - 1.96 * sqrt(0.96 + y * (n - y) / n)) / (3.842 + n)', 'low')}, {R('(y + 1.921 + 1.96 * sqrt(0.96 + y * (n - y) / n)) / (3.842 + n)', 'high')} FROM t")
def misclassification(spark, sf):
    return rnd(metrics.misclassification(_pred(spark, sf), "p1", "label"))


# ------------------------------------------------------------- per pixel

_RGB = f"WITH {A.GRID}, s AS (SELECT x, y, b1 / 50 AS r, b3 * 10 AS g, b4 * 10 AS b FROM grid), "


def _rgb(spark, sf) -> DataFrame:
    # Bands of equal means have no hue, so means must not differ by the order of their sums.
    return A.grid(spark, sf, in_order=True).select("x", "y", (F.col("b1") / 50).alias("r"), (F.col("b3") * 10).alias("g"), (F.col("b4") * 10).alias("b"))


_HSV = "h AS (SELECT *, greatest(r, g, b) AS v, greatest(r, g, b) - least(r, g, b) AS d FROM s), k AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN v = r THEN (CASE WHEN g < b THEN (g - b) / d + 6 ELSE (g - b) / d END) WHEN v = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END / 6 AS h, CASE WHEN v = 0 THEN 0 ELSE d / v END AS sat FROM h)"


@query(_RGB + _HSV + f" SELECT x, y, CASE WHEN round(h, 10) = 1 THEN 0 ELSE round(h, 10) END + 0.0 AS h, {R('sat', 's', 10)}, {R('v', 'v', 10)} FROM k")
def rgb_to_hsv(spark, sf):
    h, s, v = local.rgb_to_hsv(F.col("r"), F.col("g"), F.col("b"))
    out = rnd(_rgb(spark, sf).select("x", "y", h.alias("h"), s.alias("s"), v.alias("v")), 10)
    return out.withColumn("h", F.when(F.col("h") == 1, 0.0).otherwise(F.col("h")))


@query(_RGB + _HSV + f", q AS (SELECT x, y, h, sat, 0.5 + 0.001 * x AS p FROM k), c AS (SELECT x, y, p, sat, [((5 + h * 6) - 6 * floor((5 + h * 6) / 6)), ((3 + h * 6) - 6 * floor((3 + h * 6) / 6)), ((1 + h * 6) - 6 * floor((1 + h * 6) / 6))] AS k FROM q) SELECT x, y, " + ", ".join(R(f"p - p * sat * greatest(0, least(k[{i}], 4 - k[{i}], 1))", f"sharp_{c}", 10) for i, c in ((1, "r"), (2, "g"), (3, "b"))) + " FROM c")
def pansharpen_hsv(spark, sf):
    out = local.pansharpen_hsv(_rgb(spark, sf).withColumn("pan", 0.5 + 0.001 * F.col("x")), "r", "g", "b", "pan")
    return rnd(out.select("x", "y", "sharp_r", "sharp_g", "sharp_b"), 10)


@query(f"WITH {A.GRID} SELECT x, y, {R('CASE WHEN (x + y) % 2 = 0 THEN b1 ELSE -b1 END', 'modulated')}, {R('CASE WHEN b3 > 0.05 THEN 0 ELSE least(greatest(b1 * 2 + b4, 20), 80) END', 'algebra')} FROM grid")
def image_algebra(spark, sf):
    g = A.grid(spark, sf, in_order=True)  # cut at 0.05
    clipped = local.clamp(F.col("b1") * 2 + F.col("b4"), 20.0, 80.0)
    return rnd(g.select("x", "y", (F.col("b1") * local.checkerboard(F.col("x"), F.col("y"))).alias("modulated"), local.where(clipped, (F.col("b3") > 0.05).cast("int"), F.lit(0.0)).alias("algebra")))


@query("SELECT l_partkey AS id, count(*) AS n FROM (SELECT l_partkey, l_quantity AS a, l_extendedprice AS b, CASE WHEN l_discount > 0.05 THEN 0 ELSE l_discount END AS c, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_linenumber = 2 THEN 'nan'::DOUBLE ELSE l_tax END AS d FROM lineitem) WHERE a + b <> 0 AND c + CASE WHEN d IS NULL OR isnan(d) THEN 0 ELSE d END <> 0 GROUP BY 1")
def valid_pixels(spark, sf):
    li = A.table(spark, sf, "lineitem")
    d = F.when(F.col("l_linenumber") == 1, None).when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_tax"))
    px = li.select(F.col("l_partkey").alias("id"), F.col("l_quantity").alias("a"), F.col("l_extendedprice").alias("b"), F.when(F.col("l_discount") > 0.05, 0.0).otherwise(F.col("l_discount")).alias("c"), d.alias("d"))
    return local.valid_pixels(px, ["a", "b"], ["c", "d"]).groupBy("id").agg(F.count("*").alias("n"))


@query(f"WITH {A.GRID} SELECT x * 2 + i AS x, y * 2 + j AS y, {R('b1', 'b1')} FROM grid, range(0, 2) a(i), range(0, 2) b(j)")
def block_repeat(spark, sf):
    return rnd(local.block_repeat(A.grid(spark, sf), 2, ["b1"]))


@query(f"WITH {A.GRID}, n AS (SELECT i AS x, j AS y, floor(i * 50 / 70)::BIGINT AS sx, floor(j * 60 / 45)::BIGINT AS sy FROM range(0, 70) a(i), range(0, 45) b(j)) SELECT n.x, n.y, {R('b1', 'b1')} FROM n JOIN grid g ON g.x = sx AND g.y = sy")
def resample_nearest(spark, sf):
    return rnd(local.resample_nearest(A.grid(spark, sf), 50, 60, 70, 45, ["b1"]))


@query(
    f"WITH {A.GRID}, n AS (SELECT i AS x, j AS y, i * 49.0 / 69 AS u, j * 59.0 / 44 AS v FROM range(0, 70) a(i), range(0, 45) b(j)), s AS (SELECT n.x, n.y, b1, (1 - abs(u - g.x)) * (1 - abs(v - g.y)) AS w FROM n JOIN grid g ON g.x BETWEEN floor(u) AND ceil(u) AND g.y BETWEEN floor(v) AND ceil(v) WHERE g.x BETWEEN 0 AND 49 AND g.y BETWEEN 0 AND 59) "
    f"SELECT x, y, {R('sum(w * b1)', 'b1')} FROM s GROUP BY x, y HAVING sum(w) > 1 - 1e-9"
)
def resample_linear(spark, sf):
    return rnd(local.resample_linear(A.grid(spark, sf), 50, 60, 70, 45, "b1"))


@query(f"WITH {A.PIXELS}, m AS (SELECT avg(b1) AS m1, stddev_samp(b1) AS s1, avg(b3) AS m3, stddev_samp(b3) AS s3 FROM pixels) SELECT id, count(*) AS n, {R('sum((b1 - m1) / s1)', 'z1')}, {R('sum((b3 - m3) / s3)', 'z3')}, {R('sum(b1 / sqrt(b1 * b1 + b3 * b3))', 'u1')} FROM pixels, m GROUP BY id")
def standardized_bands(spark, sf):
    z = regress.unit_length(regress.standardized(A.pixels(spark, sf).select("id", "b1", "b3"), ["b1", "b3"]), ["b1", "b3"])
    return rnd(z.groupBy("id").agg(F.count("*").alias("n"), F.sum("z_b1").alias("z1"), F.sum("z_b3").alias("z3"), F.sum("u_b1").alias("u1")))


# ------------------------------------------------------------- transforms

_M2 = "m AS (SELECT avg(b1) AS m1, avg(b3) AS m3, var_samp(b1) AS s11, var_samp(b3) AS s33, covar_samp(b1, b3) AS s13 FROM pixels)"


@query(
    f"WITH {A.PIXELS}, {_M2}, e AS (SELECT *, (s11 + s33 + sqrt((s11 - s33) ** 2 + 4 * s13 * s13)) / 2 AS l FROM m), v AS (SELECT *, (l - s33) / sqrt((l - s33) ** 2 + s13 * s13) AS u1, s13 / sqrt((l - s33) ** 2 + s13 * s13) AS u3 FROM e) "
    f"SELECT id, b1, b3, {R('((b1 - m1) * u1 + (b3 - m3) * u3) * u1', 'rec_b1', 5)}, {R('((b1 - m1) * u1 + (b3 - m3) * u3) * u3', 'rec_b3', 5)} FROM pixels, v"
)
def pca_reconstruction(spark, sf):
    return rnd(classify.pca_reconstruction(A.pixels(spark, sf).select("id", "b1", "b3"), ["b1", "b3"], 1), 5, ("b1", "b3"))


@query(
    f"WITH {A.GRID}, g AS (SELECT x, y, b1 AS a, b3 * 100 AS b FROM grid WHERE x BETWEEN 1 AND 40 AND y BETWEEN 5 AND 44), s AS (SELECT var_samp(a) AS s11, var_samp(b) AS s22, covar_samp(a, b) AS s12 FROM g), "
    "d AS (SELECT c.a - (l.a + u.a) / 2 AS a, c.b - (l.b + u.b) / 2 AS b FROM g c JOIN g l ON l.y = c.y AND l.x = CASE WHEN c.x = 1 THEN 40 ELSE c.x - 1 END JOIN g u ON u.x = c.x AND u.y = CASE WHEN c.y = 5 THEN 44 ELSE c.y - 1 END), "
    "n AS (SELECT sum(a * a) / (2 * (count(*) - 1)) AS n11, sum(b * b) / (2 * (count(*) - 1)) AS n22, sum(a * b) / (2 * (count(*) - 1)) AS n12 FROM d), "
    "q AS (SELECT s11 * s22 - s12 * s12 AS qa, -(n11 * s22 + n22 * s11 - 2 * n12 * s12) AS qb, n11 * n22 - n12 * n12 AS qc FROM s, n), l AS (SELECT (-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS l1, (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS l2 FROM q) "
    f"SELECT {R('l1', 'lambda1')}, {R('l2', 'lambda2')}, {R('1 / l1 - 1', 'snr1')}, {R('1 / l2 - 1', 'snr2')}, 1.0::DOUBLE AS var1 FROM l"
)
def noise_fractions(spark, sf):
    g = A.grid(spark, sf).filter("x between 1 and 40 and y between 5 and 44").select((F.col("x") - 1).alias("x"), (F.col("y") - 5).alias("y"), F.col("b1").alias("a"), (F.col("b3") * 100).alias("b"))
    out, values, snr = transforms.noise_fraction(g, ["a", "b"], 40, 40)
    v = lambda x, n: F.round(F.lit(float(x)), 6).alias(n)
    return out.agg(v(values[0], "lambda1"), v(values[1], "lambda2"), v(snr[0], "snr1"), v(snr[1], "snr2"), F.round(F.var_samp("mnf1"), 6).alias("var1"))


_E50 = "e AS (SELECT vec_id, embedding FROM embeddings ORDER BY vec_id LIMIT 60)"
_GRAM = "g AS (SELECT a.vec_id AS i, b.vec_id AS j, exp(-list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))) / 2) AS k FROM e a, e b)"


def _few(spark, sf) -> DataFrame:
    return A.table(spark, sf, "embeddings").orderBy("vec_id").limit(60).select("vec_id", "embedding")


@query(f"WITH {_E50}, {_GRAM} SELECT i, j, {R('k', 'k', 8)} FROM g")
def kernel_matrix(spark, sf):
    return rnd(transforms.gram_matrix(_few(spark, sf), "vec_id", "embedding", "gaussian", sigma=1.0), 8)


@query(f"WITH {_E50}, {_GRAM} SELECT i, j, round(k - avg(k) OVER (PARTITION BY i) - avg(k) OVER (PARTITION BY j) + avg(k) OVER (), 8) + 0.0 AS k FROM g")
def kernel_centred(spark, sf):
    return rnd(transforms.centre_matrix(transforms.gram_matrix(_few(spark, sf), "vec_id", "embedding", "gaussian", sigma=1.0)), 8)


def _px(spark, sf) -> DataFrame:
    """Pixels with a key of their own and bands of like size."""
    return A.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), "l_partkey", F.col("l_quantity").alias("a"), (F.col("l_discount") * 500).alias("b"))


def _landmarks(spark, sf, n: int) -> DataFrame:
    d = _px(spark, sf)
    return d.orderBy(metrics.hash_order(F.col("key")), "key", "l_partkey", "a", "b").limit(n)


@query()
def kernel_pca(spark, sf):
    out, _ = transforms.kernel_pca(_px(spark, sf), _landmarks(spark, sf, 100), ["a", "b"], 2)
    return rnd(out.groupBy("l_partkey").agg(F.avg("kpc1").alias("kpc1"), F.avg("kpc2").alias("kpc2")), 4)


@query()
def kernel_rx(spark, sf):
    return rnd(transforms.kernel_rx(_px(spark, sf), _landmarks(spark, sf, 200), ["a", "b"]).groupBy("l_partkey").agg(F.max("krx").alias("krx")), 4)


@query()
def kernel_kmeans(spark, sf):
    return transforms.kernel_kmeans(_px(spark, sf), _landmarks(spark, sf, 200), ["a", "b"], 3).groupBy("cluster").agg(F.count("*").alias("n"))


# ------------------------------------------------------------- clusters


@query(
    f"WITH {A.PIXELS}, px AS (SELECT *, row_number() OVER () AS rid FROM pixels), first AS (SELECT b1 AS x, b3 AS y FROM pixels ORDER BY (id * 2654435761) % 1000003, id, b1, b3 LIMIT 1), "
    "far AS (SELECT b1 AS x, b3 AS y FROM pixels, first ORDER BY (b1 - x) ** 2 + (b3 - y) ** 2 DESC, id, b1 DESC, b3 DESC LIMIT 1), "
    f"{kmeans_sql(5, 'SELECT 1 AS k, x, y FROM first UNION ALL SELECT 2, x, y FROM far', 'px')} SELECT k AS cluster, count(*) AS n, {R('avg(b1)', 'b1', 4)} FROM final GROUP BY k"
)
def kmeans_farthest_first(spark, sf):
    px = A.pixels(spark, sf)
    out, _, _ = cluster.kmeans(px, ["b1", "b3"], cluster.farthest_first(px, ["b1", "b3"], 2, "id"), 5)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("b1"), 4).alias("b1"))


def _em_sql(rounds: int) -> str:
    """One band, two components, memberships from a cut at 25; rounds written out."""
    parts = ["u0 AS (SELECT rid, b1, CASE WHEN b1 <= 25 THEN 0.9 ELSE 0.1 END AS u FROM px)"]
    for t in range(1, rounds + 1):
        parts.append(f"m{t} AS MATERIALIZED (SELECT avg(u) AS w1, avg(1 - u) AS w2, sum(u * b1) / sum(u) AS c1, sum((1 - u) * b1) / sum(1 - u) AS c2, sum(u * b1 * b1) / sum(u) - (sum(u * b1) / sum(u)) ** 2 AS v1, sum((1 - u) * b1 * b1) / sum(1 - u) - (sum((1 - u) * b1) / sum(1 - u)) ** 2 AS v2 FROM u{t - 1})")
        parts.append(f"u{t} AS (SELECT rid, b1, w1 / sqrt(v1) * exp(-((b1 - c1) ** 2) / (2 * v1)) / (w1 / sqrt(v1) * exp(-((b1 - c1) ** 2) / (2 * v1)) + w2 / sqrt(v2) * exp(-((b1 - c2) ** 2) / (2 * v2))) AS u FROM px, m{t})")
    return ", ".join(parts)


@query(f"WITH {A.PIXELS}, px AS (SELECT b1, row_number() OVER () AS rid FROM pixels), {_em_sql(6)} SELECT b1, count(*) AS n, {R('avg(u)', 'u1', 5)}, CASE WHEN avg(u) >= 0.5 THEN 1 ELSE 2 END AS cluster, floor(avg(u) * 255)::INTEGER AS byte1 FROM u6 GROUP BY b1")
def gaussian_mixture(spark, sf):
    px = A.pixels(spark, sf).select("b1")
    u = F.when(F.col("b1") <= 25, 0.9).otherwise(0.1)
    out, _, _ = cluster.gaussian_mixture(px, ["b1"], px.withColumns({"u1": u, "u2": 1 - u}), 2, rounds=5)
    hard = cluster.hardened(out.select(F.col("b1").alias("v"), "u1", "u2"), 2)
    return hard.groupBy(F.col("v").alias("b1")).agg(F.count("*").alias("n"), F.round(F.avg("u1"), 5).alias("u1"), F.max("cluster").alias("cluster"), F.max("b1").alias("byte1"))


def _ek_sql(rounds: int) -> str:
    parts = ["h AS (SELECT floor(b1)::DOUBLE AS v, count(*)::DOUBLE AS c FROM pixels GROUP BY 1), n AS (SELECT sum(c) AS n FROM h), k0 AS (SELECT v AS m, c / n AS p, 99.0::DOUBLE AS delta FROM h, n)"]
    cost = "(v - m) ** 2 / 40.0 + ln(p) / (2 * ln(0.1))"
    for t in range(1, rounds + 1):
        parts.append(f"g{t} AS MATERIALIZED (SELECT m, p FROM k{t - 1} WHERE p > 0.01)")
        parts.append(f"a{t} AS (SELECT v, c, arg_min(m, {{'d': {cost}, 'm': m}}) AS m FROM h, g{t} GROUP BY v, c)")
        parts.append(f"k{t} AS MATERIALIZED (SELECT coalesce(x, 0.0) AS m, coalesce(s, 0.0) / n AS p, m AS was FROM (SELECT g.m, sum(c) AS s, sum(c * v) / sum(c) AS x FROM g{t} g LEFT JOIN a{t} a USING (m) GROUP BY g.m), n)")
    return ", ".join(parts)


@query(f"WITH {A.PIXELS}, {_ek_sql(3)} SELECT dense_rank() OVER (ORDER BY m)::INTEGER AS cluster, sum(c)::BIGINT AS n, min(v) AS low, max(v) AS high FROM a3 GROUP BY m")
def extended_kmeans(spark, sf):
    out, _ = cluster.extended_kmeans(A.pixels(spark, sf), "b1", 20.0, 10, 3)
    rows = out.groupBy("cluster").agg(F.count("*").alias("n"), F.min(F.floor("b1")).cast("double").alias("low"), F.max(F.floor("b1")).cast("double").alias("high"))
    return rows.select(F.dense_rank().over(Window.orderBy("low")).alias("cluster"), "n", "low", "high")  # a row a cluster


@query()
def ward_clusters(spark, sf):
    return sampling.ward_map(A.pixels(spark, sf).select("id", "b1", (F.col("b3") * 100).alias("b3")), "id", ["b1", "b3"], 3, 300).groupBy("cluster").agg(F.count("*").alias("n"))


# ------------------------------------------------------------- classifiers


@query(
    f"WITH {A.PIXELS}, c AS (SELECT cls, count(*) AS n, avg(b1) AS m1, avg(b3) AS m3, var_pop(b1) AS v1, var_pop(b3) AS v3 FROM pixels GROUP BY cls), g AS (SELECT p.rid, p.cls AS label, c.cls, ln(n / (SELECT sum(n) FROM c)) - 0.5 * ln(v1 * v3) - (b1 - m1) ** 2 / (2 * v1) - (b3 - m3) ** 2 / (2 * v3) AS g FROM (SELECT *, row_number() OVER () AS rid FROM pixels) p, c) "
    "SELECT label, pred, count(*) AS n FROM (SELECT rid, label, arg_max(cls, g) AS pred FROM g GROUP BY 1, 2) GROUP BY 1, 2"
)
def naive_bayes(spark, sf):
    return learn.naive_bayes(A.pixels(spark, sf), ["b1", "b3"], "cls").groupBy(F.col("cls").alias("label"), "pred").agg(F.count("*").alias("n"))


@query(
    f"WITH {A.PIXELS}, w AS (SELECT count(*) AS n, avg(b1) AS m1, avg(b3) AS m3, stddev_samp(b1) AS s1, stddev_samp(b3) AS s3 FROM pixels), c AS (SELECT cls, count(*) AS k, avg(b1) AS c1, avg(b3) AS c3 FROM pixels GROUP BY cls), "
    "d AS (SELECT *, sqrt(1.0 / k - 1.0 / n) AS f, (s1 + s3) / 2 AS s0 FROM c, w), e AS (SELECT *, (c1 - m1) / (f * (s1 + s0)) AS d1, (c3 - m3) / (f * (s3 + s0)) AS d3 FROM d), "
    "t AS (SELECT *, m1 + f * (s1 + s0) * sign(d1) * greatest(abs(d1) - 0.1, 0) AS x1, m3 + f * (s3 + s0) * sign(d3) * greatest(abs(d3) - 0.1, 0) AS x3 FROM e), "
    "g AS (SELECT p.rid, p.cls AS label, t.cls, 2 * ln(k / n) - (b1 - x1) ** 2 / s1 ** 2 - (b3 - x3) ** 2 / s3 ** 2 AS g FROM (SELECT *, row_number() OVER () AS rid FROM pixels) p, t) SELECT label, pred, count(*) AS n FROM (SELECT rid, label, arg_max(cls, g) AS pred FROM g GROUP BY 1, 2) GROUP BY 1, 2"
)
def shrunken_centroids(spark, sf):
    return learn.shrunken_centroids(A.pixels(spark, sf), ["b1", "b3"], "cls", 0.1)[0].groupBy(F.col("cls").alias("label"), "pred").agg(F.count("*").alias("n"))


def _perceptron_sql(rounds: int) -> str:
    parts = ["q0 AS (SELECT 0.0::DOUBLE AS w1, 0.0::DOUBLE AS w3, 0.0::DOUBLE AS bias)"]
    for t in range(1, rounds + 1):
        e = "(t - CASE WHEN z1 * w1 + z3 * w3 + bias > 0 THEN 1.0 ELSE 0.0 END)"
        parts.append(f"q{t} AS MATERIALIZED (SELECT max(w1) + 0.1 * avg({e} * z1) AS w1, max(w3) + 0.1 * avg({e} * z3) AS w3, max(bias) + 0.1 * avg({e}) AS bias FROM z, q{t - 1})")
    return ", ".join(parts)


@query(f"WITH {A.PIXELS}, z AS (SELECT b1 / 50 AS z1, b3 * 10 AS z3, (cls = 'R')::INTEGER::DOUBLE AS t FROM pixels), {_perceptron_sql(12)} SELECT {R('w1', 'w1')}, {R('w3', 'w3')}, {R('bias', 'bias')} FROM q12")
def perceptron(spark, sf):
    px = A.pixels(spark, sf).select((F.col("b1") / 50).alias("z1"), (F.col("b3") * 10).alias("z3"), "cls")
    _, w, bias, _ = learn.perceptron(px, ["z1", "z3"], F.col("cls") == "R", 0.1, 0.0, 12)
    return rnd(spark.createDataFrame([(float(w[0]), float(w[1]), float(bias))], "w1 double, w3 double, bias double"))


@query(
    f"WITH {A.PIXELS}, t AS (SELECT b1, b3, (cls = 'R') AS p FROM pixels ORDER BY (id * 2654435761) % 1000003, id, b1, b3, cls LIMIT 80), k AS (SELECT a.p AS pa, b.p AS pb, avg(exp(-((a.b1 - b.b1) ** 2 + (a.b3 - b.b3) ** 2) / 200)) AS k FROM t a, t b GROUP BY 1, 2), "
    "q AS (SELECT b1, b3, count(*) AS n FROM pixels GROUP BY 1, 2), s AS (SELECT q.b1, q.b3, q.n, avg(exp(-((q.b1 - t.b1) ** 2 + (q.b3 - t.b3) ** 2) / 200)) FILTER (WHERE p) - avg(exp(-((q.b1 - t.b1) ** 2 + (q.b3 - t.b3) ** 2) / 200)) FILTER (WHERE NOT p) + ((SELECT k FROM k WHERE NOT pa AND NOT pb) - (SELECT k FROM k WHERE pa AND pb)) / 2 AS s FROM q, t GROUP BY 1, 2, 3) "
    f"SELECT s > 0 AS pred, sum(n)::BIGINT AS n, {R('sum(s * n)', 'total', 4)} FROM s GROUP BY 1"
)
def parzen_classifier(spark, sf):
    px = A.pixels(spark, sf)
    train = px.orderBy(metrics.hash_order(F.col("id")), "id", "b1", "b3", "cls").limit(80).withColumn("p", F.col("cls") == "R")
    out = learn.parzen(px.select("b1", "b3"), train, ["b1", "b3"], "p", 10.0)
    return out.groupBy("pred").agg(F.count("*").alias("n"), F.round(F.sum("score"), 4).alias("total"))


_GINI = "nl - (al * al + bl * bl + cl * cl) / nl + (n - nl) - ((a - al) ** 2 + (b - bl) ** 2 + (c - cl) ** 2) / (n - nl)"


def _stump_sql() -> str:
    t = "SELECT '{0}' AS band, v, lead(v) OVER (ORDER BY v) AS nxt, sum(a) OVER w AS al, sum(b) OVER w AS bl, sum(c) OVER w AS cl, sum(a + b + c) OVER w AS nl, sum(a) OVER () AS a, sum(b) OVER () AS b, sum(c) OVER () AS c, sum(a + b + c) OVER () AS n FROM (SELECT {0} AS v, count(*) FILTER (WHERE cls = 'A')::DOUBLE AS a, count(*) FILTER (WHERE cls = 'N')::DOUBLE AS b, count(*) FILTER (WHERE cls = 'R')::DOUBLE AS c FROM pixels GROUP BY 1) WINDOW w AS (ORDER BY v)"
    return f"WITH {A.PIXELS}, s AS ({t.format('b1')} UNION ALL {t.format('b3')}), g AS (SELECT *, {_GINI} AS cost FROM s WHERE nxt IS NOT NULL), best AS (SELECT * FROM g ORDER BY cost, band, v LIMIT 1), "


@query(
    _stump_sql() + "side AS (SELECT p.cls, CASE WHEN CASE band WHEN 'b1' THEN b1 ELSE b3 END <= (v + nxt) / 2 THEN 0 ELSE 1 END AS right_ FROM pixels p, best), votes AS (SELECT right_, cls, count(*) AS n FROM side GROUP BY 1, 2), top AS (SELECT right_, arg_max(cls, n) AS pred FROM votes GROUP BY 1) SELECT cls, pred, sum(n)::BIGINT AS n FROM votes JOIN top USING (right_) GROUP BY 1, 2"
)
def class_stump(spark, sf):
    return learn.class_tree(A.pixels(spark, sf), ["b1", "b3"], "cls", stumps=True).groupBy("cls", "pred").agg(F.count("*").alias("n"))


@query()
def class_tree(spark, sf):
    return learn.class_tree(A.pixels(spark, sf), ["b1", "b3"], "cls", depth=4).groupBy("cls", "pred").agg(F.count("*").alias("n"))


@query()
def boosted_trees(spark, sf):
    return learn.boosted_trees(A.pixels(spark, sf), ["b1", "b3"], "cls", 10)[0].groupBy("cls", "pred").agg(F.count("*").alias("n"))


@query()
def neural_network(spark, sf):
    px = A.pixels(spark, sf).select("b1", "b3", (F.col("b1") > 25).cast("string").alias("cls"))
    return learn.neural_network(px, px.orderBy("b1", "b3").limit(2000), ["b1", "b3"], "cls", 4, 60).groupBy("cls", "pred").agg(F.count("*").alias("n"))


_CV = "c AS (SELECT f.fold, p.cls, count(*) AS n, avg(b1) AS m1, avg(b3) AS m3, var_samp(b1) AS s11, var_samp(b3) AS s33, covar_samp(b1, b3) AS s13 FROM (SELECT DISTINCT fold FROM p) f JOIN p ON p.fold <> f.fold GROUP BY 1, 2)"


@query(
    "WITH p AS (SELECT c_custkey AS key, c_acctbal / 1000 AS b1, length(c_name) + c_nationkey AS b3, c_mktsegment AS cls, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * 2654435761) % 1000003, c_custkey) - 1) % 10)::INTEGER AS fold FROM customer), "
    + _CV
    + ", g AS (SELECT p.key, p.fold, p.cls AS label, c.cls, ln(n / sum(n) OVER (PARTITION BY p.key)) - 0.5 * ln(s11 * s33 - s13 * s13) - (s33 * (b1 - m1) ** 2 - 2 * s13 * (b1 - m1) * (b3 - m3) + s11 * (b3 - m3) ** 2) / (s11 * s33 - s13 * s13) / 2 AS g FROM p JOIN c USING (fold)) SELECT fold, count(*) AS n, sum((pred <> label)::INTEGER)::BIGINT AS n_wrong FROM (SELECT key, fold, label, arg_max(cls, g) AS pred FROM g GROUP BY 1, 2, 3) GROUP BY fold"
)
def cross_validation(spark, sf):
    c = A.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), (F.col("c_acctbal") / 1000).alias("b1"), (F.length("c_name") + F.col("c_nationkey")).alias("b3"), F.col("c_mktsegment").alias("cls"))
    return learn.cross_validate(c, "key", ["b1", "b3"], "cls", 10)


# ------------------------------------------------------------- regressions


@query(
    f"WITH {A.PIXELS}, m AS (SELECT avg(b1) AS m1, avg(b3) AS m3, avg(b4) AS my, covar_pop(b1, b4) * count(*) AS x1, covar_pop(b3, b4) * count(*) AS x3, var_pop(b1) * count(*) AS a, var_pop(b3) * count(*) AS b, covar_pop(b1, b3) * count(*) AS c FROM pixels), "
    "w AS (SELECT *, x1 / sqrt(x1 * x1 + x3 * x3) AS w1, x3 / sqrt(x1 * x1 + x3 * x3) AS w3 FROM m), q AS (SELECT *, (w1 * x1 + w3 * x3) / (w1 * w1 * a + 2 * w1 * w3 * c + w3 * w3 * b) AS q FROM w) "
    "SELECT 'b1' AS name, round(q * w1, 9) + 0.0 AS beta FROM q UNION ALL SELECT 'b3', round(q * w3, 9) + 0.0 FROM q UNION ALL SELECT 'intercept', round(my - q * w1 * m1 - q * w3 * m3, 9) + 0.0 FROM q"
)
def partial_least_squares(spark, sf):
    return rnd(regress.partial_least_squares(A.pixels(spark, sf), ["b1", "b3"], "b4", 1), 9)


@query(
    f"WITH {A.PIXELS}, m AS (SELECT avg(b1) AS m1, avg(b4) AS my, stddev_samp(b1) AS sd, covar_pop(b1, b4) / stddev_samp(b1) AS c, var_pop(b1) / var_samp(b1) AS a FROM pixels), z AS (SELECT *, sign(c) * greatest(abs(c) - 0.00001, 0) / (a + 0.1) / sd AS beta FROM m) SELECT 'b1' AS name, round(beta, 9) + 0.0 AS beta FROM z UNION ALL SELECT 'intercept', round(my - beta * m1, 9) + 0.0 FROM z"
)
def elastic_net(spark, sf):
    return rnd(regress.elastic_net(A.pixels(spark, sf), ["b1"], "b4", 0.00001, 0.1), 9)


@query(
    f"WITH {A.PIXELS}, n AS (SELECT (count(*) - 1) AS k, var_samp(b1) AS a, var_samp(b3) AS b, covar_samp(b1, b3) AS c, covar_samp(b1, b4) AS x, covar_samp(b3, b4) AS y, avg(b1) AS m1, avg(b3) AS m3, avg(b4) AS my FROM pixels), r AS (SELECT m1, m3, my, (a * k + 10) AS a, (b * k + 10) AS b, c * k AS c, x * k AS x, y * k AS y FROM n), s AS (SELECT *, (b * x - c * y) / (a * b - c * c) AS p, (a * y - c * x) / (a * b - c * c) AS q FROM r) "
    "SELECT 'b1' AS name, round(p, 8) + 0.0 AS beta FROM s UNION ALL SELECT 'b3', round(q, 8) + 0.0 FROM s UNION ALL SELECT 'intercept', round(my - p * m1 - q * m3, 8) + 0.0 FROM s"
)
def ridge_any_bands(spark, sf):
    return rnd(regress.least_squares(A.pixels(spark, sf), ["b1", "b3"], "b4", 10.0), 8)


@query()
def least_angles(spark, sf):
    return rnd(regress.least_angles(A.pixels(spark, sf), ["b1", "b2", "b3"], "b4"), 8)


@query(
    "WITH p AS (SELECT ps * 1.5 - pp / 100 + 7 + 0.01 * (pk % 7) AS base_x, ps / 100.0 + pp * 1.5 - 3 + 0.02 * (pk % 5) AS base_y, ps::DOUBLE AS warp_x, pp AS warp_y FROM (SELECT p_size AS ps, p_retailprice AS pp, p_partkey AS pk FROM part)), "
    "m AS (SELECT count(*) AS n, avg(base_x) AS mx, avg(base_y) AS my, avg(warp_x) AS mu, avg(warp_y) AS mv FROM p), s AS (SELECT max(n) AS n, max(mx) AS mx, max(my) AS my, max(mu) AS mu, max(mv) AS mv, sum((warp_x - mu) ** 2 + (warp_y - mv) ** 2) AS uu, sum((warp_x - mu) * (base_x - mx) + (warp_y - mv) * (base_y - my)) AS ux, sum((warp_x - mu) * (base_y - my) - (warp_y - mv) * (base_x - mx)) AS uy FROM p, m), "
    "f AS (SELECT *, ux / uu AS a, uy / uu AS b FROM s), e AS (SELECT sqrt(sum((base_x - mx - a * (warp_x - mu) + b * (warp_y - mv)) ** 2 + (base_y - my - b * (warp_x - mu) - a * (warp_y - mv)) ** 2) / count(*)) AS rms FROM p, f) "
    f"SELECT {R('a', 'a')}, {R('b', 'b')}, {R('mx - a * mu + b * mv', 'x0', 4)}, {R('my - b * mu - a * mv', 'y0', 4)}, {R('rms', 'rms', 4)} FROM f, e"
)
def control_point_fit(spark, sf):
    p, s, r = A.table(spark, sf, "part"), F.col("p_size"), F.col("p_retailprice")
    pts = p.select((s * 1.5 - r / 100 + 7 + 0.01 * (F.col("p_partkey") % 7)).alias("base_x"), (s / 100.0 + r * 1.5 - 3 + 0.02 * (F.col("p_partkey") % 5)).alias("base_y"), s.cast("double").alias("warp_x"), r.alias("warp_y"))
    return regress.rigid_fit(pts).select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), F.round("x0", 4).alias("x0"), F.round("y0", 4).alias("y0"), F.round("rms", 4).alias("rms"))


# ------------------------------------------------------------- whole images

_SQ = "w AS (SELECT x, y, b1 AS v, floor(b1 / 20) AS k FROM grid WHERE x BETWEEN 1 AND 40 AND y BETWEEN 5 AND 44)"


def _square(spark, sf) -> DataFrame:
    g = A.grid(spark, sf).filter("x between 1 and 40 and y between 5 and 44")
    return g.select((F.col("x") - 1).alias("x"), (F.col("y") - 5).alias("y"), F.col("b1").alias("v"))


_CLAMP = "c AS (SELECT a.x - 1 AS x, a.y - 5 AS y, a.v AS own, n.v, dx, dy FROM w a, (VALUES (-1), (0), (1)) p(dx), (VALUES (-1), (0), (1)) q(dy), w n WHERE n.x = least(greatest(a.x + dx, 1), 40) AND n.y = least(greatest(a.y + dy, 5), 44))"


@query(f"WITH {A.GRID}, {_SQ}, {_CLAMP} SELECT x, y, {R('median(v)', 'v')} FROM c GROUP BY x, y")
def median_reflected(spark, sf):
    return rnd(focal.median_reflected(_square(spark, sf), "v", 40, 40))


@query(f"WITH {A.GRID}, {_SQ}, {_CLAMP} SELECT x, y, {R('sum(v) / 4', 'v')} FROM c WHERE (dx = 0) <> (dy = 0) GROUP BY x, y")
def four_mean(spark, sf):
    return rnd(focal.four_mean(_square(spark, sf), ["v"], 40, 40))


_P2 = "p AS (SELECT x, y, 0.2 + 0.6 * v / 50 AS p0, 0.8 - 0.6 * v / 50 AS p1 FROM w), l AS (SELECT x, y, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS k FROM p)"


@query(
    f"WITH {A.GRID}, {_SQ}, {_P2}, pr AS (SELECT a.k AS i, b.k AS j FROM l a JOIN l b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1)), s AS (SELECT count(*) FILTER (WHERE i = 0 AND j = 0) / greatest(count(*) FILTER (WHERE i = 0), 1) AS s00, count(*) FILTER (WHERE i = 0 AND j = 1) / greatest(count(*) FILTER (WHERE i = 0), 1) AS s01, count(*) FILTER (WHERE i = 1 AND j = 0) / greatest(count(*) FILTER (WHERE i = 1), 1) AS s10, count(*) FILTER (WHERE i = 1 AND j = 1) / greatest(count(*) FILTER (WHERE i = 1), 1) AS s11 FROM pr), "
    "n AS (SELECT a.x, a.y, a.p0, a.p1, avg(b.p0) AS n0, avg(b.p1) AS n1 FROM p a, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dx, dy), p b WHERE b.x = least(greatest(a.x + dx, 1), 40) AND b.y = least(greatest(a.y + dy, 5), 44) GROUP BY ALL), "
    f"f AS (SELECT x - 1 AS x, y - 5 AS y, p0 * (n0 * s00 + n1 * s01) AS f0, p1 * (n0 * s10 + n1 * s11) AS f1 FROM n, s) SELECT x, y, {R('f0 / (f0 + f1)', 'p0')}, {R('f1 / (f0 + f1)', 'p1')} FROM f"
)
def label_relaxation(spark, sf):
    g = _square(spark, sf).select("x", "y", (0.2 + 0.6 * F.col("v") / 50).alias("p0"), (0.8 - 0.6 * F.col("v") / 50).alias("p1"))
    return rnd(focal.relax_labels(g, ["p0", "p1"], 40, 40))


_GRAD = "nb AS (SELECT a.x, a.y, n.v, n.x - a.x AS dx, n.y - a.y AS dy FROM w a JOIN w n ON n.x BETWEEN a.x - 1 AND a.x + 1 AND n.y BETWEEN a.y - 1 AND a.y + 1), gr AS (SELECT x, y, sum(v * dx * (2 - abs(dy))) AS gx, sum(v * dy * (2 - abs(dx))) AS gy FROM nb GROUP BY x, y HAVING count(*) = 9)"


@query(f"WITH {A.GRID}, {_SQ}, {_GRAD} SELECT x - 1 AS x, y - 5 AS y, {R('gx', 'gx')}, {R('gy', 'gy')}, {R('sqrt(gx * gx + gy * gy)', 'length')} FROM gr")
def gradient(spark, sf):
    return rnd(focal.gradient(_square(spark, sf), "v"))


@query(f"WITH {A.GRID}, {_SQ}, {_GRAD}, t AS (SELECT a.x, a.y, sum(b.gx * b.gx) AS xx, sum(b.gx * b.gy) AS xy, sum(b.gy * b.gy) AS yy FROM gr a JOIN gr b ON b.x BETWEEN a.x - 3 AND a.x + 3 AND b.y BETWEEN a.y - 3 AND a.y + 3 GROUP BY a.x, a.y HAVING count(*) = 49) SELECT x - 1 AS x, y - 5 AS y, {R('(xx + yy - sqrt((xx - yy) ** 2 + 4 * xy * xy)) / 2', 'corner', 2)} FROM t")
def corner_strength(spark, sf):
    return rnd(focal.corners(_square(spark, sf), "v"), 2)


@query(f"WITH {A.GRID}, {_SQ}, {_GRAD}, s AS (SELECT *, sqrt(gx * gx + gy * gy) / 8 AS g FROM gr) SELECT x - 1 AS x, y - 5 AS y, {R('degrees(atan(g))', 'slope')}, {R('CASE WHEN gx = 0 AND gy = 0 THEN 0 WHEN atan2(-gx, gy) < 0 THEN degrees(atan2(-gx, gy)) + 360 ELSE degrees(atan2(-gx, gy)) END', 'aspect')} FROM s")
def slope_aspect(spark, sf):
    return rnd(focal.slope_aspect(_square(spark, sf), "v"))


_LOG = "lk AS (SELECT dx, dy, ((dx * dx + dy * dy) - 2) * exp(-(dx * dx + dy * dy) / 2.0) AS wt FROM range(-3, 4) a(dx), range(-3, 4) b(dy)), lg AS (SELECT a.x, a.y, sum(n.v * (wt - (SELECT avg(wt) FROM lk))) AS v FROM w a, lk, w n WHERE n.x = a.x + dx AND n.y = a.y + dy GROUP BY a.x, a.y HAVING count(*) = 49)"


@query(f"WITH {A.GRID}, {_SQ}, {_LOG} SELECT a.x - 1 AS x, a.y - 5 AS y, {R('a.v', 'v')}, coalesce(bool_or(a.v * b.v < 0), FALSE) AS crossing FROM lg a LEFT JOIN lg b ON (b.x = a.x + 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y + 1) GROUP BY a.x, a.y, a.v")
def zero_crossings(spark, sf):
    return rnd(focal.zero_crossings(_square(spark, sf), "v"))


@query(f"WITH {A.GRID}, {_SQ} SELECT a.x - 1 AS x, a.y - 5 AS y, coalesce(bool_or(a.k <> b.k), FALSE) AS boundary FROM w a LEFT JOIN w b ON (b.x = a.x - 1 AND b.y = a.y) OR (b.x = a.x AND b.y = a.y - 1) GROUP BY a.x, a.y")
def segment_boundaries(spark, sf):
    return focal.segment_boundaries(_square(spark, sf).select("x", "y", F.floor(F.col("v") / 20).alias("label")))


_E = "{0} / pow(n, {1})"


@query(
    f"WITH {A.GRID}, o AS (SELECT floor(b1 / 10)::BIGINT AS label, x, y FROM grid), m AS (SELECT label, count(*)::DOUBLE AS n, avg(x) AS cx, avg(y) AS cy FROM o GROUP BY 1), u AS (SELECT label, n, x - cx AS u, y - cy AS v FROM o JOIN m USING (label)), "
    "s AS (SELECT label, sum(u * u) / pow(max(n), 2) AS e20, sum(v * v) / pow(max(n), 2) AS e02, sum(u * v) / pow(max(n), 2) AS e11, sum(u * u * u) / pow(max(n), 2.5) AS e30, sum(v * v * v) / pow(max(n), 2.5) AS e03, sum(u * u * v) / pow(max(n), 2.5) AS e21, sum(u * v * v) / pow(max(n), 2.5) AS e12 FROM u GROUP BY label) "
    f"SELECT label, {R('e20 + e02', 'hu1')}, {R('(e20 - e02) ** 2 + 4 * e11 ** 2', 'hu2')}, {R('(e30 - 3 * e12) ** 2 + (3 * e21 - e03) ** 2', 'hu3')} FROM s"
)
def hu_moments(spark, sf):
    return rnd(focal.hu_moments(A.grid(spark, sf).select(F.floor(F.col("b1") / 10).alias("label"), "x", "y")))


_S3, _R2 = "sqrt(3.0)", "(4 * sqrt(2.0))"
_D4 = f"f(i, h, g) AS (VALUES (0, (1 + {_S3}) / {_R2}, (1 - {_S3}) / {_R2}), (1, (3 + {_S3}) / {_R2}, -(3 - {_S3}) / {_R2}), (2, (3 - {_S3}) / {_R2}, (3 + {_S3}) / {_R2}), (3, (1 - {_S3}) / {_R2}, -(1 + {_S3}) / {_R2}))"


@query(
    f"WITH {A.GRID}, {_SQ}, z AS (SELECT x - 1 AS x, y - 5 AS y, v FROM w), {_D4}, o AS (SELECT i AS x, j AS y FROM range(0, 20) a(i), range(0, 20) b(j)) "
    "SELECT o.x, o.y, " + ", ".join(R(f"sum(v * a.{p} * b.{q})", n) for n, p, q in (("ll", "h", "h"), ("hl", "g", "h"), ("lh", "h", "g"), ("hh", "g", "g"))) + " FROM o, f a, f b, z WHERE z.x = (2 * o.x + a.i) % 40 AND z.y = (2 * o.y + b.i) % 40 GROUP BY o.x, o.y"
)
def wavelet_quadrants(spark, sf):
    return rnd(focal.dwt2(_square(spark, sf), series.D4, "v", 40, 40))


@query(f"WITH {A.GRID}, {_SQ} SELECT x - 1 AS x, y - 5 AS y, {R('v', 'v')} FROM w")
def wavelet_round_trip(spark, sf):
    cells = _square(spark, sf)
    back = focal.idwt2(focal.dwt2(cells, series.D4, "v", 40, 40), series.D4, 40, 40)
    return rnd(back.join(cells.select("x", "y"), ["x", "y"], "left_semi"))


@query(
    f"WITH {A.GRID}, {_SQ}, t(d, k) AS (VALUES (-4, 1 / 16.0), (-2, 4 / 16.0), (0, 6 / 16.0), (2, 4 / 16.0), (4, 1 / 16.0)), s AS (SELECT a.x, a.y, a.v AS own, sum(n.v * p.k * q.k) AS smooth FROM w a, t p, t q, w n WHERE n.x = a.x + p.d AND n.y = a.y + q.d GROUP BY a.x, a.y, a.v HAVING count(*) = 25) "
    f"SELECT x - 1 AS x, y - 5 AS y, {R('smooth', 'smooth')}, {R('own - smooth', 'detail')} FROM s"
)
def atrous_image(spark, sf):
    return rnd(focal.atrous2(_square(spark, sf), "v", 2))


# ------------------------------------------------------------- series

_SER = "ser AS (SELECT s, list(v ORDER BY d)[1:16] AS v FROM signal GROUP BY s)"


def _series16(spark, sf) -> DataFrame:
    g = A.signal(spark, sf).groupBy("s").agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("v"))
    return g.select("s", F.slice(F.transform("v", lambda x: x["v"]), 1, 16).alias("v"))


def _out(c: str, name: str) -> str:
    return f"array_to_string([printf('%.8f', round(u, 8) + 0.0) FOR u IN {c}], ',') AS {name}"


def _text(c: str, name: str):
    return F.array_join(F.transform(c, lambda u: F.format_string("%.8f", F.round(u, 8) + 0.0)), ",").alias(name)


@query(
    f"WITH {A.SIGNAL}, {_SER}, a AS (SELECT s, v, [(v[2 * k + 1] + v[2 * k + 2]) / sqrt(2.0) FOR k IN range(0, 8)] AS s1, [(v[2 * k + 1] - v[2 * k + 2]) / sqrt(2.0) FOR k IN range(0, 8)] AS d1 FROM ser), b AS (SELECT *, [(s1[2 * k + 1] + s1[2 * k + 2]) / sqrt(2.0) FOR k IN range(0, 4)] AS s2, [(s1[2 * k + 1] - s1[2 * k + 2]) / sqrt(2.0) FOR k IN range(0, 4)] AS d2 FROM a) "
    f"SELECT s, {_out('list_concat(list_concat(s2, d2), d1)', 'w')}, {_out('v', 'back')}, len([u FOR u IN list_concat(list_concat(s2, d2), d1) IF abs(u) >= 2])::INTEGER AS n_left FROM b"
)
def haar_series(spark, sf):
    d = series.dwt(_series16(spark, sf), "v", "w", series.HAAR, 2)
    d = series.idwt(d, "w", "back", series.HAAR, 2)
    d = series.haar_truncated(d, "v", "cut", 2, 2.0)
    return d.select("s", _text("w", "w"), _text("back", "back"), "n_left")


@query(
    f"WITH {A.SIGNAL}, {_SER}, a AS (SELECT s, [(v[t + 1] + v[(t + 15) % 16 + 1]) / 2 FOR t IN range(0, 16)] AS s1 FROM ser) SELECT s, {_out('[(s1[t + 1] + s1[(t + 14) % 16 + 1]) / 2 FOR t IN range(0, 16)]', 'smooth')}, {_out('[(s1[t + 1] - s1[(t + 14) % 16 + 1]) / 2 FOR t IN range(0, 16)]', 'detail')} FROM a"
)
def stationary_haar(spark, sf):
    s1, _ = series.uwt_step(F.col("v"), series.HAAR, 1)
    d = _series16(spark, sf).withColumn("s1", s1)
    s2, d2 = series.uwt_step(F.col("s1"), series.HAAR, 2)
    return d.select("s", s2.alias("a"), d2.alias("b")).select("s", _text("a", "smooth"), _text("b", "detail"))


@query(f"WITH {A.SIGNAL}, q AS (SELECT s, list(v ORDER BY d)[1:11] AS v FROM signal GROUP BY s) SELECT s, {_out('[CASE WHEN i < 11 THEN v[i + 1] ELSE v[22 - i] END FOR i IN range(0, 16)]', 'reflection')}, {_out('[v[i % 11 + 1] FOR i IN range(0, 16)]', 'periodic')}, {_out('[CASE WHEN i < 11 THEN v[i + 1] ELSE 0.0 END FOR i IN range(0, 16)]', 'zeros')} FROM q")
def padded_series(spark, sf):
    d = _series16(spark, sf).select("s", F.slice("v", 1, 11).alias("v"))
    d = d.select("s", *[series.pad(F.col("v"), m).alias(m) for m in ("reflection", "periodic", "zeros")])
    return d.select("s", *[_text(m, m) for m in ("reflection", "periodic", "zeros")])


_NUM = "nm AS (SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY d) - 1 AS i FROM signal)"


@query(f"WITH {A.SIGNAL}, {_NUM}, t AS (SELECT s, f, sum(v * cos(-2 * pi() * f * i / 24)) AS re, sum(v * sin(-2 * pi() * f * i / 24)) AS im FROM nm, range(0, 13) g(f) WHERE i < 24 GROUP BY s, f) SELECT s, f::INTEGER AS f, {R('re * re + im * im', 'power', 3)} FROM t")
def power_spectrum(spark, sf):
    n = A.signal(spark, sf).withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("d")) - 1).filter("i < 24")
    return rnd(series.power_spectrum(n, "s", "i", "v", 24), 3)


@query()
def continuous_wavelets(spark, sf):
    d = _series16(spark, sf).select("s", series.cwt_modulus(F.col("v"), 1.0, [2.0, 4.0]).alias("w"))
    return d.select("s", _text("w", "w"))


# ------------------------------------------------------------- simulated images

_BM = "sqrt(-2 * ln(((i * 2654435761 + {k} * 7919 * 104729::BIGINT) % 1000003 + 1) / 1000004.0)) * cos(2 * pi() * (((i + 17) * 2654435761 + {k} * 15485863::BIGINT) % 1000003) / 1000003.0)"


@query(
    "WITH p AS (SELECT i, " + ", ".join(f"{_BM.format(k=k)} AS n{k}" for k in range(12)) + " FROM range(0, 400) t(i)) "
    f"SELECT i AS id, {R(' + '.join(f'n{4 * m} * n{4 * m} + n{4 * m + 1} * n{4 * m + 1}' for m in range(3)), 'c1')}, {R(' + '.join(f'n{4 * m} * n{4 * m + 2} + n{4 * m + 1} * n{4 * m + 3}' for m in range(3)), 'c2')}, {R(' + '.join(f'n{4 * m + 1} * n{4 * m + 2} - n{4 * m} * n{4 * m + 3}' for m in range(3)), 'c3')}, {R(' + '.join(f'n{4 * m + 2} * n{4 * m + 2} + n{4 * m + 3} * n{4 * m + 3}' for m in range(3)), 'c4')} FROM p"
)
def wishart_image(spark, sf):
    return rnd(sampling.wishart_dual(spark, 400, 3))


@query(f"SELECT i AS id, (i % 3)::INTEGER AS cluster, {R('(i % 3) * 2 + ' + _BM.format(k=20), 'b1')}, {R('(i % 3) * -2 + ' + _BM.format(k=21), 'b2')} FROM range(0, 300) t(i)")
def toy_clusters(spark, sf):
    return rnd(sampling.toy_clusters(spark, 300, 3))



# ------------------------------------------------------------- fits, names, logs


@query("WITH s AS (SELECT a.i AS a, b.i AS b FROM range(0, 4) a(i), range(0, 4) b(i) WHERE a.i < b.i), n AS (SELECT *, (row_number() OVER (ORDER BY a, b) - 1)::INTEGER AS split FROM s) SELECT split, i::INTEGER AS place, (i = a OR i = b) AS test FROM n, range(0, 4) p(i)")
def all_splits(spark, sf):
    return fits.all_splits(spark, 4, 50)


@query("SELECT p_partkey, round(gamma(p_size / 10.0 + 0.5), 6) + 0.0 AS g, round(factorial((p_size % 15)::INTEGER)::DOUBLE, 0) AS f FROM part")
def gamma_factorial(spark, sf):
    p = A.table(spark, sf, "part")
    return p.select("p_partkey", (F.round(fits.gamma(F.col("p_size") / 10.0 + 0.5), 6) + 0.0).alias("g"), F.factorial((F.col("p_size") % 15).cast("int")).cast("double").alias("f"))


@query("SELECT url FROM pages WHERE regexp_matches(url, '/en/[0-9]+') AND NOT regexp_matches(url, '[?#]')")
def series_files(spark, sf):
    return fits.series_files(A.table(spark, sf, "pages").select("url"), "url", "/en/[0-9]+", "[?#]")


@query("SELECT 'o_orderkey: ' || o_orderkey || '; o_orderpriority: ' || o_orderpriority || '; o_orderstatus: ' || o_orderstatus AS line FROM orders")
def metadata_log(spark, sf):
    return fits.metadata_log(A.table(spark, sf, "orders"), ["o_orderkey", "o_orderpriority", "o_orderstatus"])


@query(
    f"WITH {A.PAIR}, m AS (SELECT avg(a1) AS m1, avg(c1) AS m2, var_samp(a1) AS s11, var_samp(c1) AS s22, covar_samp(a1, c1) AS s12 FROM pair), e AS (SELECT *, (s11 + s22 - sqrt((s11 - s22) ** 2 + 4 * s12 * s12)) / 2 AS l FROM m), v AS (SELECT *, s12 / sqrt(s12 * s12 + (l - s11) ** 2) AS u1, (l - s11) / sqrt(s12 * s12 + (l - s11) ** 2) AS u2 FROM e) "
    f"SELECT id, {R('abs((a1 - m1) * u1 + (c1 - m2) * u2)', 'change', 5)} FROM pair, v"
)
def bitemporal_pca(spark, sf):
    out, _, _ = classify.pca(A.pair(spark, sf).select("id", "a1", "c1"), ["a1", "c1"])
    return rnd(out.select("id", F.abs("pc2").alias("change")), 5)


@query()
def iterated_pca(spark, sf):
    out, _ = fits.iterated_pca(A.pair(spark, sf).select("id", "a1", "c1"), "a1", "c1")
    return rnd(out.select("id", F.abs("pc2").alias("change")), 4)


@query()
def kernel_ridge(spark, sf):
    d = _px(spark, sf)
    out = fits.kernel_ridge(d.select("l_partkey", "a", "b"), _landmarks(spark, sf, 100).withColumn("y", F.col("a") + F.col("b")), ["a", "b"], "y", 0.1, 20.0)
    return rnd(out.groupBy("l_partkey").agg(F.avg("fit").alias("fit")), 3)


@query()
def organizing_map(spark, sf):
    return fits.organizing_map(_px(spark, sf), _landmarks(spark, sf, 500), ["a", "b"], 3).groupBy("cell").agg(F.count("*").alias("n"))


_M2K = "m AS (SELECT avg(b1) AS m1, avg(b3) AS m3, var_samp(b1) AS s11, var_samp(b3 * 100) AS s33, covar_samp(b1, b3 * 100) AS s13 FROM pixels)"


@query(f"WITH {A.PIXELS}, {_M2K} SELECT {R('(s11 + s33 + sqrt((s11 - s33) ** 2 + 4 * s13 * s13)) / 2', 'first', 4)}, {R('(s11 + s33 - sqrt((s11 - s33) ** 2 + 4 * s13 * s13)) / 2', 'second', 4)} FROM m")
def leading_components(spark, sf):
    px = A.pixels(spark, sf).select("b1", (F.col("b3") * 100).alias("b3"))
    _, v = fits.leading_component(px, ["b1", "b3"], 2)
    return rnd(spark.createDataFrame([tuple(map(float, v))], "first double, second double"), 4)


_SCATTER = (
    "t AS (SELECT var_pop(b1) * count(*) AS t11, var_pop(b3) * count(*) AS t33, covar_pop(b1, b3) * count(*) AS t13 FROM pixels), c AS (SELECT cls, var_pop(b1) * count(*) AS w11, var_pop(b3) * count(*) AS w33, covar_pop(b1, b3) * count(*) AS w13 FROM pixels GROUP BY cls), "
    "b AS (SELECT t11, t33, t13, t11 - sum(w11) AS b11, t33 - sum(w33) AS b33, t13 - sum(w13) AS b13 FROM t, c GROUP BY 1, 2, 3), q AS (SELECT t11 * t33 - t13 * t13 AS qa, -(b11 * t33 + b33 * t11 - 2 * b13 * t13) AS qb, b11 * b33 - b13 * b13 AS qc FROM b)"
)


@query(f"WITH {A.PIXELS}, {_SCATTER} SELECT {R('(-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa)', 'first', 8)}, {R('(-qb - sqrt(qb * qb - 4 * qa * qc)) / (2 * qa)', 'second', 8)} FROM q")
def discriminant_shares(spark, sf):
    _, share = regress.discriminant_axes(A.pixels(spark, sf), ["b1", "b3"], "cls")
    return rnd(spark.createDataFrame([tuple(map(float, share))], "first double, second double"), 8)


@query(
    f"WITH {A.PIXELS}, c AS (SELECT cls, avg(b1) AS m1, avg(b3) AS m3, var_samp(b1) AS s11, var_samp(b3) AS s33, covar_samp(b1, b3) AS s13 FROM pixels GROUP BY cls), p AS (SELECT a.cls AS c1, b.cls AS c2, a.m1 - b.m1 AS d1, a.m3 - b.m3 AS d3, (a.s11 + b.s11) / 2 AS s11, (a.s33 + b.s33) / 2 AS s33, (a.s13 + b.s13) / 2 AS s13, (a.s11 * a.s33 - a.s13 * a.s13) * (b.s11 * b.s33 - b.s13 * b.s13) AS dd FROM c a JOIN c b ON a.cls < b.cls), "
    "h AS (SELECT c1, c2, (s33 * d1 * d1 - 2 * s13 * d1 * d3 + s11 * d3 * d3) / (s11 * s33 - s13 * s13) / 8 + 0.5 * ln((s11 * s33 - s13 * s13) / sqrt(dd)) AS b FROM p) "
    f"SELECT c1, c2, {R('b', 'bhattacharyya', 8)}, {R('2 * (1 - exp(-b))', 'jm', 8)} FROM h"
)
def separability_two_band(spark, sf):
    return rnd(moments.separability(A.pixels(spark, sf), ["b1", "b3"], "cls"), 8)


@query(
    f"WITH {A.PIXELS}, n AS (SELECT var_samp(b1) AS a, var_samp(b3) AS b, covar_samp(b1, b3) AS c, covar_samp(b1, b4) AS x, covar_samp(b3, b4) AS y, avg(b1) AS m1, avg(b3) AS m3, avg(b4) AS my FROM pixels), s AS (SELECT *, (b * x - c * y) / (a * b - c * c) AS p, (a * y - c * x) / (a * b - c * c) AS q FROM n) "
    "SELECT 'b1' AS name, round(p, 8) + 0.0 AS beta FROM s UNION ALL SELECT 'b3', round(q, 8) + 0.0 FROM s UNION ALL SELECT 'intercept', round(my - p * m1 - q * m3, 8) + 0.0 FROM s"
)
def least_squares_any_bands(spark, sf):
    return rnd(regress.least_squares(A.pixels(spark, sf), ["b1", "b3"], "b4"), 8)


@query(f"WITH {A.SIGNAL}, {_SER} SELECT s, {_out('v', 'back')} FROM ser")
def stationary_round_trip(spark, sf):
    d = _series16(spark, sf)
    s1, d1 = series.uwt_step(F.col("v"), series.D4, 1)
    d = d.select("s", s1.alias("s1"), d1.alias("d1"))
    s2, d2 = series.uwt_step(F.col("s1"), series.D4, 2)
    d = d.select("s", "d1", s2.alias("s2"), d2.alias("d2")).select("s", "d1", series.iuwt_step(F.col("s2"), F.col("d2"), series.D4, 2).alias("s1"))
    return d.select("s", series.iuwt_step(F.col("s1"), F.col("d1"), series.D4, 1).alias("v")).select("s", _text("v", "back"))
