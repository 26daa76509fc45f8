"""Means, covariances, regressions and information measures over pixel tables.

Every operator is one aggregation with map-side partial sums; only matrices of band size
reach the driver.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moments(df: DataFrame, bands: list[str], by: list[str] = ()) -> DataFrame:
    """Count, means and sample covariances (divisor m - 1), per group."""
    aggs = [F.count("*").alias("n")] + [F.avg(b).alias(f"mean_{b}") for b in bands]
    aggs += [F.covar_samp(a, b).alias(f"cov_{a}_{b}") for a, b in combinations_with_replacement(bands, 2)]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def weighted_moments(df: DataFrame, bands: list[str], weight: Column, ddof: float = 1.0, shift: dict[str, float] | None = None) -> DataFrame:
    """Weighted means and covariances with divisor sum(w) - ddof, mergeable over partitions.
    Values are shifted against cancellation: by ``shift``, or by means from a first pass."""
    w = df.withColumn("w_", weight.cast("double"))
    if shift is None:
        d = w.join(F.broadcast(w.agg(*[F.avg(b).alias(f"s_{b}") for b in bands])))
    else:
        d = w.withColumns({f"s_{b}": F.lit(float(shift[b])) for b in bands})
    x = {b: F.col(b) - F.col(f"s_{b}") for b in bands}
    sums = [F.sum("w_").alias("sw")] + [F.max(f"s_{b}").alias(f"s_{b}") for b in bands] + [F.sum(F.col("w_") * x[b]).alias(f"m_{b}") for b in bands]
    sums += [F.sum(F.col("w_") * x[a] * x[b]).alias(f"c_{a}_{b}") for a, b in combinations_with_replacement(bands, 2)]
    t = d.agg(*sums)
    out = [F.col("sw").alias("sum_w")] + [(F.col(f"s_{b}") + F.col(f"m_{b}") / F.col("sw")).alias(f"mean_{b}") for b in bands]
    out += [((F.col(f"c_{a}_{b}") - F.col(f"m_{a}") * F.col(f"m_{b}") / F.col("sw")) / (F.col("sw") - ddof)).alias(f"cov_{a}_{b}") for a, b in combinations_with_replacement(bands, 2)]
    return t.select(*out)


def matrices(row, bands: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean vector and covariance matrix of a row of ``moments`` or ``weighted_moments``."""
    mean = np.array([row[f"mean_{b}"] for b in bands], float)
    cov = np.zeros((len(bands), len(bands)))
    for (i, a), (j, b) in combinations_with_replacement(list(enumerate(bands)), 2):
        cov[i, j] = cov[j, i] = row[f"cov_{a}_{b}"]
    return mean, cov


def noise_covariance(grid: DataFrame, bands: list[str]) -> DataFrame:
    """Covariance of differences to the next row's cell, over 2 (m - 1)."""
    w = Window.partitionBy("x").orderBy("y")
    d = grid.select(F.lead("y").over(w).alias("ny"), "y", *[(F.lead(b).over(w) - F.col(b)).alias(b) for b in bands]).filter("ny = y + 1")
    return d.agg(F.count("*").alias("n"), *[(F.covar_samp(a, b) / 2).alias(f"cov_{a}_{b}") for a, b in combinations_with_replacement(bands, 2)])


def mutual_information(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """In nats, over the joint histogram of two discrete columns."""
    joint = df.groupBy(a.alias("a"), b.alias("b")).agg(F.count("*").alias("c"))
    pa = joint.groupBy("a").agg(F.sum("c").alias("ca"))
    pb = joint.groupBy("b").agg(F.sum("c").alias("cb"))
    total = joint.agg(F.sum("c").alias("n"))
    j = joint.join(pa, "a").join(pb, "b").join(F.broadcast(total))
    return j.agg(F.sum(F.col("c") / F.col("n") * F.log(F.col("c") * F.col("n") / (F.col("ca") * F.col("cb")))).alias("mi"))


def correlation(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null where a band is constant."""
    r = F.try_divide(F.covar_samp(x, y), F.sqrt(F.var_samp(x) * F.var_samp(y)))
    return F.when(r.isNotNull(), F.greatest(F.least(r, F.lit(1.0)), F.lit(-1.0)))


def orthogonal_regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """Total least squares y = a + b x, with the correlation r.  Uncorrelated bands: slope 0 if
    x varies more than y, else null (a vertical line), r null if a band is constant."""
    m = df.agg(F.avg(x).alias("mx"), F.avg(y).alias("my"), F.var_samp(x).alias("sxx"), F.var_samp(y).alias("syy"), F.covar_samp(x, y).alias("sxy"), correlation(x, y).alias("r"))
    d = F.col("syy") - F.col("sxx")
    b = F.coalesce(F.try_divide(d + F.sqrt(d * d + 4 * F.col("sxy") * F.col("sxy")), 2 * F.col("sxy")), F.when((F.col("sxy") == 0) & (d < 0), 0.0))
    return m.select(b.alias("slope"), (F.col("my") - b * F.col("mx")).alias("intercept"), "r")


def linear_regression(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), correlation(x, y).alias("r"))


def multiple_regression(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0) -> tuple[np.ndarray, float, int]:
    """Coefficients, intercept and rank by normal equations on centred sums, from one
    aggregation; the pseudo-inverse where regressors depend on one another."""
    row = moments(df, [*xs, y]).first()
    mean, cov = matrices(row, [*xs, y])
    k, s = len(xs), cov * (row["n"] - 1)
    a = s[:k, :k] + ridge * np.eye(k)
    beta = np.linalg.pinv(a, hermitian=True) @ s[:k, k]
    return beta, float(mean[k] - beta @ mean[:k]), int(np.linalg.matrix_rank(a, hermitian=True))


def two_band_ols(df: DataFrame, x1: str, x2: str, y: str, ridge: float = 0.0) -> DataFrame:
    """Ordinary (or ridge) least squares on two regressors, in closed form; null for
    regressors that depend on one another."""
    m = moments(df, [x1, x2, y])
    k = F.col("n") - 1
    s11, s22, s12 = F.col(f"cov_{x1}_{x1}") * k + ridge, F.col(f"cov_{x2}_{x2}") * k + ridge, F.col(f"cov_{x1}_{x2}") * k
    t1, t2 = F.col(f"cov_{x1}_{y}") * k, F.col(f"cov_{x2}_{y}") * k
    det = s11 * s22 - s12 * s12
    b1, b2 = F.try_divide(s22 * t1 - s12 * t2, det), F.try_divide(s11 * t2 - s12 * t1, det)
    return m.select(b1.alias("beta1"), b2.alias("beta2"), (F.col(f"mean_{y}") - b1 * F.col(f"mean_{x1}") - b2 * F.col(f"mean_{x2}")).alias("intercept"))


def separability(df: DataFrame, bands: list[str], by: str) -> DataFrame:
    """Jeffries-Matusita distance for each pair of classes over several bands."""
    rows = {r[by]: matrices(r, bands) for r in moments(df, bands, [by]).collect()}  # one row a class
    out = []
    for a in sorted(rows):
        for b in sorted(rows):
            if a < b:
                (m1, s1), (m2, s2) = rows[a], rows[b]
                s, d = (s1 + s2) / 2, m1 - m2
                bh = d @ np.linalg.solve(s, d) / 8 + 0.5 * np.log(np.linalg.det(s) / np.sqrt(np.linalg.det(s1) * np.linalg.det(s2)))
                out.append((a, b, float(bh), float(2 * (1 - np.exp(-bh)))))
    return df.sparkSession.createDataFrame(out, "c1 string, c2 string, bhattacharyya double, jm double")


def jeffries_matusita(df: DataFrame, band: str, cls: str) -> DataFrame:
    """Separability of each two classes in one band.  Only the classes' moments, one row a
    class, meet one another."""
    m = df.groupBy(cls).agg(F.avg(band).alias("m"), F.var_samp(band).alias("v"))
    a, b = (m.select(F.col(cls).alias(f"c{i}"), F.col("m").alias(f"m{i}"), F.col("v").alias(f"v{i}")) for i in (1, 2))
    v = F.col("v1") + F.col("v2")
    dist = (F.col("m1") - F.col("m2")) ** 2 / (4 * v) + 0.5 * F.log(v / (2 * F.sqrt(F.col("v1") * F.col("v2"))))
    rows = a.join(b, F.col("c1") < F.col("c2")).select("c1", "c2", dist.alias("bhattacharyya"))
    return rows.withColumn("jm", 2 * (1 - F.exp(-F.col("bhattacharyya"))))
