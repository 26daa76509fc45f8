"""Change detection and normalization: MAD and its iteration, change maps, radiometric
normalization, sequential omnibus tests on radar series, terrain correction."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cdf import chi2_cdf, f_cdf, t_cdf
from .local import determinant
from .moments import correlation, linear_regression, orthogonal_regression


def _inv_sqrt(s: np.ndarray) -> np.ndarray:
    v, u = np.linalg.eigh(s)
    return u @ np.diag(1 / np.sqrt(np.maximum(v, 1e-300))) @ u.T


def canonical(mean: np.ndarray, cov: np.ndarray, n: int, ridge: float = 0.0):
    """Canonical vectors of the two halves of ``2n`` bands, by descending correlation; signs
    such that the first half's vectors sum to a positive correlation with the bands and the
    second half's correlate positively with the first's."""
    s11, s22, s12 = cov[:n, :n] + ridge * np.eye(n), cov[n:, n:] + ridge * np.eye(n), cov[:n, n:]
    l1, l2 = _inv_sqrt(s11), _inv_sqrt(s22)
    u, rho, vt = np.linalg.svd(l1 @ s12 @ l2)
    a, b = l1 @ u, l2 @ vt.T
    sign = np.sign(((np.diag(1 / np.sqrt(np.diag(s11))) @ s11) @ a).sum(0))
    sign[sign == 0] = 1
    return a * sign, b * sign, np.clip(rho, 0, 1 - 1e-12)


def imad(df: DataFrame, first: list[str], second: list[str], iterations: int = 50, tol: float = 1e-3, ridge: float = 0.0, ddof: float = 1.0) -> tuple[DataFrame, np.ndarray]:
    """Iteratively reweighted multivariate alteration detection.

    One weighted aggregation per round over the input, which is cached for the loop and
    released after it; a round's canonical vectors return as one row of columns, so the
    generated code is the same each round and no lineage grows.  ``ddof`` 0 gives population
    covariances.  Gives the rows with mad1..madN (most correlated last), chi2 and p_nochange,
    and the correlations.  An empty input gives an empty result and zero correlations."""
    n = len(first)
    bands = [*first, *second]
    rho, old = np.zeros(n), np.zeros(n)
    held = df.select(*bands).cache()
    shift = held.agg(*[F.avg(b).alias(b) for b in bands]).first().asDict()
    if any(v is None for v in shift.values()):
        held.unpersist()
        none = F.lit(None).cast("double")
        return df.limit(0).select("*", *[none.alias(f"mad{i + 1}") for i in range(n)], none.alias("chi2"), none.alias("p_nochange")), rho
    model = None
    for _ in range(iterations):
        rows = held.selectExpr(*[f"`{b}`" for b in bands], "1D AS w_") if model is None else _no_change(_variates(held, first, second, model), n).selectExpr(*[f"`{b}`" for b in bands], "p_nochange AS w_")
        mean, cov = _moments(rows, bands, shift, ddof)
        a, b, rho = canonical(mean, cov, n, ridge)
        model = (mean, a, b, rho)
        if np.max(np.abs(rho - old)) <= tol:
            break
        old = rho
    held.unpersist()
    return _no_change(_variates(df, first, second, model), n), rho


def _moments(rows: DataFrame, bands: list[str], shift: dict[str, float], ddof: float) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariances weighted by w_, from sums of shifted values.  Expressions are text:
    a round then takes a few calls into the engine and not hundreds."""
    x = rows.selectExpr("w_", *[f"`{b}` - ({shift[b]!r}D) AS x{i}" for i, b in enumerate(bands)])
    n = range(len(bands))
    r = x.selectExpr("sum(w_) AS sw", *[f"sum(w_ * x{i}) AS s{i}" for i in n], *[f"sum(w_ * x{i} * x{j}) AS s{i}_{j}" for i in n for j in n if i <= j]).first()
    m = np.array([r[f"s{i}"] for i in n]) / r["sw"]
    c = np.array([[r[f"s{min(i, j)}_{max(i, j)}"] for j in n] for i in n])
    return m + np.array([shift[b] for b in bands]), (c - r["sw"] * np.outer(m, m)) / (r["sw"] - ddof)


def _variates(df: DataFrame, first: list[str], second: list[str], model) -> DataFrame:
    """mad1.. and chi2 beside every row; the model comes as one broadcast row."""
    mean, a, b, rho = model
    n = len(first)
    values = {f"m_{i}": mean[i] for i in range(2 * n)} | {f"a_{i}_{j}": a[i, j] for i in range(n) for j in range(n)} | {f"b_{i}_{j}": b[i, j] for i in range(n) for j in range(n)} | {f"s_{j}": 2 * (1 - rho[j]) for j in range(n)}
    row = df.sparkSession.range(1).selectExpr(*[f"double('{float(v)!r}') AS {k}" for k, v in values.items()])
    mad = lambda j: " + ".join([f"(`{c}` - m_{i}) * a_{i}_{j} - (`{d}` - m_{n + i}) * b_{i}_{j}" for i, (c, d) in enumerate(zip(first, second))])
    own = [f"`{c}`" for c in df.columns]
    rows = df.join(F.broadcast(row)).selectExpr(*own, *[f"{mad(n - 1 - j)} AS mad{j + 1}" for j in range(n)], *[f"s_{j}" for j in range(n)])
    return rows.selectExpr(*own, *[f"mad{j + 1}" for j in range(n)], " + ".join(f"mad{n - j} * mad{n - j} / s_{j}" for j in range(n)) + " AS chi2")


def _no_change(df: DataFrame, n: int) -> DataFrame:
    return df.withColumn("p_nochange", 1 - chi2_cdf(F.col("chi2"), n))


def mad_single_band(df: DataFrame, x: str, y: str) -> DataFrame:
    """One pass of MAD for one band, in closed form.  A constant band counts as its mean
    everywhere and uncorrelated; without variance at all mad and chi2 are 0."""
    r = F.coalesce(correlation(x, y), F.lit(0.0))
    s = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.stddev_samp(x).alias("sx"), F.stddev_samp(y).alias("sy"), r.alias("r"))
    d = df.join(F.broadcast(s))
    unit = lambda c, m, sd: F.coalesce(F.try_divide(F.col(c) - F.col(m), F.col(sd)), F.lit(0.0))
    d = d.withColumn("mad", unit(x, "mx", "sx") - F.signum("r") * unit(y, "my", "sy"))
    return d.withColumn("chi2", F.coalesce(F.try_divide(F.col("mad") * F.col("mad"), 2 * (1 - F.abs("r"))), F.lit(0.0))).drop("mx", "my", "sx", "sy", "r")


def change_map(df: DataFrame, n: int, alpha: float = 0.95, zero: tuple[str, ...] = ()) -> DataFrame:
    """p_nochange and a flag from a column chi2; the bands ``zero`` become 0 where the
    probability of no change exceeds ``alpha``."""
    out = _no_change(df, n).withColumn("changed", F.col("p_nochange") <= alpha)
    return out.withColumns({b: F.when(F.col("changed"), F.col(b)).otherwise(F.lit(0.0)) for b in zero})


def radiometric_normalization(df: DataFrame, target: str, reference: str, nochange: Column, train: Column) -> DataFrame:
    """Orthogonal regression of the reference on the target over training no-change pixels,
    with the fit's error on the hold-out."""
    kept = df.filter(nochange)
    fit = orthogonal_regression(kept.filter(train), target, reference)
    held = kept.filter(~train).join(F.broadcast(fit))
    e = F.col(reference) - (F.col("intercept") + F.col("slope") * F.col(target))
    return held.agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.count("*").alias("n_test"), F.avg(e).alias("mean_error"), F.stddev_samp(e).alias("sd_error"))


def normalization_fits(df: DataFrame, bands: list[tuple[str, str]], nochange: Column, train: Column) -> DataFrame:
    """One row per (target, reference) band: the fit on training no-change pixels and the tests
    of equal means (pooled variance) and equal variances (larger over smaller) of reference and
    normalized target on the hold-out.  All bands in one aggregation each; p-values of these few
    rows on the driver."""
    stacked = df.filter(nochange).select(train.alias("train"), F.explode(F.array(*[F.struct(F.lit(t).alias("band"), F.col(t).cast("double").alias("y"), F.col(r).cast("double").alias("x")) for t, r in bands])).alias("s")).select("train", "s.*")
    m = stacked.filter("train").groupBy("band").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"), F.var_samp("y").alias("syy"), F.var_samp("x").alias("sxx"), F.covar_samp("x", "y").alias("sxy"), correlation("x", "y").alias("r"))
    d = F.col("sxx") - F.col("syy")
    slope = F.try_divide(d + F.sqrt(d * d + 4 * F.col("sxy") * F.col("sxy")), 2 * F.col("sxy"))
    fit = m.withColumn("slope", slope).select("band", "slope", (F.col("mx") - F.col("slope") * F.col("my")).alias("intercept"), "r")
    z = F.col("intercept") + F.col("slope") * F.col("y")
    held = stacked.filter(~F.col("train")).join(F.broadcast(fit), "band").withColumn("z", z)
    t = held.groupBy("band").agg(F.max("slope").alias("slope"), F.max("intercept").alias("intercept"), F.max("r").alias("r"), F.count("*").alias("n_test"), F.avg("x").alias("m1"), F.avg("z").alias("m2"), F.var_samp("x").alias("v1"), F.var_samp("z").alias("v2"))
    f = F.try_divide(F.greatest("v1", "v2"), F.least("v1", "v2"))
    return t.select("band", "slope", "intercept", "r", "n_test", F.try_divide(F.col("m1") - F.col("m2"), F.sqrt((F.col("v1") + F.col("v2")) / F.col("n_test"))).alias("t"), f.alias("f"))


def normalization_p_values(fits: DataFrame) -> dict[str, tuple[float, float]]:
    """(p of t, p of F) per band, for the few rows of ``normalization_fits``."""
    return {r["band"]: (2 * (1 - t_cdf(abs(r["t"]), 2 * r["n_test"] - 2)), 1 - f_cdf(r["f"], r["n_test"] - 1, r["n_test"] - 1)) for r in fits.collect()}


def normalized(df: DataFrame, bands: list[str], fits: DataFrame) -> DataFrame:
    """The target bands of a whole scene, normalized: intercept + slope * band."""
    wide = fits.agg(*[F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{c}_{b}") for b in bands for c in ("slope", "intercept")])
    return df.join(F.broadcast(wide)).withColumns({b: F.col(f"intercept_{b}") + F.col(f"slope_{b}") * F.col(b) for b in bands}).select(*df.columns)


def c_correction(df: DataFrame, band: str, cos_incidence: str, cos_zenith: float, by: str, min_r: float = 0.2) -> DataFrame:
    """Terrain correction per class where band and illumination correlate."""
    fit = linear_regression(df, cos_incidence, band, [by])
    c = F.try_divide("intercept", "slope")
    fixed = F.coalesce(F.try_divide(F.col(band) * (cos_zenith + c), F.col(cos_incidence) + c), F.col(band))
    return df.join(F.broadcast(fit), by).withColumn("corrected", F.when(F.col("r") > min_r, fixed).otherwise(F.col(band))).drop("slope", "intercept", "r")


# ------------------------------------------------------------- omnibus tests


#: Bands of a polarimetric matrix -> (p in ln R, p in the distribution, degrees of freedom).
LAYOUT = {9: (3, 3, 9), 4: (2, 2, 4), 3: (3, 1, 3), 2: (2, 1, 2), 1: (1, 1, 1)}


def _constants(j: int, bands: int, n: float) -> tuple[int, float, float]:
    """f, rho and omega2 of the j-th factor of the sequential test."""
    _, p, f = LAYOUT[bands]
    rho = 1 - (2 * p * p - 1) * (1 + 1 / (j * (j - 1))) / (6 * p * n)
    w = -(f / 4) * (1 - 1 / rho) ** 2 + p * p * (p * p - 1) * (1 + (2 * j - 1) / (j * (j - 1)) ** 2) / (24 * n * n * rho * rho)
    return f, rho, w


def series_arrays(series: DataFrame, k: int, pixel: str = "pix", t: str = "t", value: str | list[str] = "v") -> DataFrame:
    """One row per complete pixel with an array of its k values in order of time, per band."""
    bands = [value] if isinstance(value, str) else value
    g = series.groupBy(pixel).agg(F.array_sort(F.collect_list(F.struct(t, *bands))).alias("s"))
    return g.filter(F.size("s") == k).select(pixel, *[F.col("s").getField(b).alias(b) for b in bands])


TINY = 2.2250738585072014e-308


def _ln_det(bands: list[Column]) -> Column:
    return F.log(F.greatest(determinant(bands), F.lit(TINY)))


def _ln_r(bands: list[str], ell: int, j: int, looks: float) -> Column:
    """ln R_j of the series from image ``ell`` on, over matrices of these bands."""
    p = LAYOUT[len(bands)][0]
    at = lambda b, i: F.get(b, F.lit(i)) * looks
    total = lambda m: [sum((at(b, ell - 1 + i) for i in range(1, m)), at(b, ell - 1)) for b in bands]
    now = [at(b, ell + j - 2) for b in bands]
    return looks * (p * (j * math.log(j) - (j - 1) * math.log(j - 1)) + (j - 1) * _ln_det(total(j - 1)) + _ln_det(now) - j * _ln_det(total(j)))


def _p_value(z: str, f: int, w: Column) -> Column:
    return 1 - ((1 - w) * chi2_cdf(F.col(z), f) + w * chi2_cdf(F.col(z), f + 4))


def omnibus(arrays: DataFrame, k: int, looks: float, pixel: str = "pix", bands: list[str] = ("v",)) -> DataFrame:
    """pixel, ell (start), j, ln_r and p of every factor R_j of the series from ell on, for
    matrices in 1, 2, 3, 4 or 9 real bands.  Each pixel is one row of arrays, so nothing is
    shuffled, and each statistic is a column before its distribution is taken."""
    bands = list(bands)
    parts = []
    for ell in range(1, k):
        for j in range(2, k - ell + 2):
            f, rho, w = _constants(j, len(bands), looks)
            parts.append(F.struct(F.lit(ell).alias("ell"), F.lit(j).alias("j"), _ln_r(bands, ell, j, looks).alias("ln_r"), F.lit(-2 * rho).alias("c"), F.lit(w).alias("w")))
    f = LAYOUT[len(bands)][2]
    rows = arrays.select(pixel, F.explode(F.array(*parts)).alias("t")).select(pixel, "t.*").withColumn("z", F.col("c") * F.col("ln_r"))
    return rows.select(pixel, "ell", "j", "ln_r", _p_value("z", f, F.col("w")).alias("p"))


def _q_constants(k: int, bands: int, n: float) -> tuple[int, float, float]:
    """f, rho and omega2 of the omnibus statistic of k images."""
    _, p, _ = LAYOUT[bands]
    if bands in (2, 3):
        return (k - 1) * bands, 1.0, 0.0
    rho = 1 - (2 * p * p - 1) * (k / n - 1 / (n * k)) / (6 * (k - 1) * p)
    w = p * p * (p * p - 1) * (k / n**2 - 1 / (n * k) ** 2) / (24 * rho * rho) - p * p * (k - 1) * (1 - 1 / rho) ** 2 / 4
    return (k - 1) * p * p, rho, w


def omnibus_q(arrays: DataFrame, k: int, looks: float, pixel: str = "pix", bands: list[str] = ("v",)) -> DataFrame:
    """The omnibus statistic of the whole series: ln_q and p."""
    bands = list(bands)
    p = LAYOUT[len(bands)][0]
    logs = sum((_ln_det([F.get(b, F.lit(i)) for b in bands]) for i in range(1, k)), _ln_det([F.get(b, F.lit(0)) for b in bands]))
    total = _ln_det([sum((F.get(b, F.lit(i)) for i in range(1, k)), F.get(b, F.lit(0))) for b in bands])
    f, rho, w = _q_constants(k, len(bands), looks)
    rows = arrays.select(pixel, (looks * (p * k * math.log(k) + logs - k * total)).alias("ln_q")).withColumn("z", -2 * rho * F.col("ln_q"))
    return rows.select(pixel, "ln_q", _p_value("z", f, F.lit(w)).alias("p"))


def with_q(tests: DataFrame, k: int, looks: float, n_bands: int, pixel: str = "pix") -> DataFrame:
    """``tests`` with q: the p-value of the omnibus statistic of the series from ell on, whose
    logarithm is the sum of its factors'."""
    sums = tests.groupBy(pixel, "ell").agg(F.sum("ln_r").alias("ln_q"))
    out = None
    for ell in range(1, k):  # constants differ by the number of images left
        f, rho, w = _q_constants(k - ell + 1, n_bands, looks)
        part = sums.filter(F.col("ell") == ell).withColumn("z", -2 * rho * F.col("ln_q")).select(pixel, "ell", _p_value("z", f, F.lit(w)).alias("q"))
        out = part if out is None else out.unionByName(part)
    return tests.join(out, [pixel, "ell"])


def change_maps(tests: DataFrame, alpha: float, pixel: str = "pix", k: int | None = None) -> DataFrame:
    """Last (cmap), first (smap) and number (fmap) of changes per pixel, by a fold over
    (ell, j): a factor counts if its start is the interval of the last change.  With a column
    q both p-values must be small.  With ``k`` also bmap: 255 for each interval with a change."""
    low = (F.col("p") <= alpha) & (F.col("q") <= alpha) if "q" in tests.columns else F.col("p") <= alpha
    rows = tests.groupBy(pixel).agg(F.array_sort(F.collect_list(F.struct("ell", "j", low.alias("low")))).alias("t"))
    zero = F.struct(F.lit(0).alias("cmap"), F.lit(0).alias("smap"), F.array().cast("array<int>").alias("at"))

    def step(a: Column, t: Column) -> Column:
        hit = t["low"] & (a["cmap"] == t["ell"] - 1)
        at = t["ell"] + t["j"] - 2
        return F.struct(F.when(hit, at).otherwise(a["cmap"]).cast("int").alias("cmap"), F.when(hit & (t["ell"] == 1), at).otherwise(a["smap"]).cast("int").alias("smap"), F.when(hit, F.array_append(a["at"], at)).otherwise(a["at"]).alias("at"))

    out = rows.select(pixel, F.aggregate("t", zero, step).alias("m")).select(pixel, "m.cmap", "m.smap", F.size("m.at").cast("int").alias("fmap"), "m.at")
    if k:
        out = out.withColumn("bmap", F.transform(F.sequence(F.lit(1), F.lit(k - 1)), lambda i: F.when(F.array_contains("at", i), 255).otherwise(0)))
    return out.drop("at")


def directional_change(arrays: DataFrame, changes: DataFrame, bands: list[str], k: int, pixel: str = "pix") -> DataFrame:
    """For every interval with a change (bmap) its direction against the mean since the last
    change: 1 positive definite, 2 negative definite, 3 indefinite; 0 without change.  The mean
    starts anew at a change.  Bands: two of a diagonal matrix, four of a dual one, or one."""
    n = len(bands)
    first = F.struct(*[F.get(b, F.lit(0)).cast("double").alias(b) for b in bands])
    zero = F.struct(first.alias("avg"), F.lit(1.0).alias("r"), F.array().cast("array<int>").alias("d"))

    def step(a: Column, i: Column) -> Column:
        d = [F.get(b, i) - a["avg"][b] for b in bands]
        if n == 4:
            disc = F.sqrt((d[0] - d[3]) * (d[0] - d[3]) + 4 * (d[1] * d[1] + d[2] * d[2]))
            low, high = d[0] + d[3] - disc, d[0] + d[3] + disc
        else:
            low, high = (F.least(*d), F.greatest(*d)) if n > 1 else (d[0], d[0])
        hit = F.get("bmap", i - 1) > 0
        kind = F.when(~hit, 0).when(low > 0, 1).when(high < 0, 2).otherwise(3)
        mean = F.struct(*[F.when(hit, F.get(b, i)).otherwise(a["avg"][b] + x / (a["r"] + 1)).cast("double").alias(b) for b, x in zip(bands, d)])
        return F.struct(mean.alias("avg"), F.when(hit, 1.0).otherwise(a["r"] + 1).alias("r"), F.array_append(a["d"], kind).alias("d"))

    rows = arrays.join(changes.select(pixel, "bmap"), pixel)
    return rows.select(pixel, F.aggregate(F.sequence(F.lit(1), F.lit(k - 1)), zero, step, lambda a: a["d"]).alias("dmap"))


def changes_per_interval(changes: DataFrame) -> DataFrame:
    """How many pixels changed in each interval (from bmap)."""
    return changes.select(F.posexplode("bmap").alias("i", "b")).groupBy((F.col("i") + 1).alias("interval")).agg(F.sum((F.col("b") / 255).cast("long")).alias("n"))


def tumbling_moments(events: DataFrame, ts: str, value: str, width: str) -> DataFrame:
    """Count, mean and variance per tumbling window; batch or streaming input."""
    w = F.window(ts, width)
    return events.groupBy(w.alias("w")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")).select(F.col("w.start").alias("start"), "n", "mean", "var")

