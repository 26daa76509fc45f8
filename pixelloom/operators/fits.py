"""Fits on bounded samples, and small tables made from parameters."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .moments import matrices, moments
from .regress import gram_schmidt, scatters
from .transforms import _scored, kernel


def all_splits(spark: SparkSession, n: int, percent: float) -> DataFrame:
    """(split, place, test) for every choice of a share of n rows as test rows."""
    k = int(n * percent / 100)
    rows = [(i, place, place in chosen) for i, chosen in enumerate(combinations(range(n), k)) for place in range(n)]
    return spark.createDataFrame(rows, "split int, place int, test boolean")


#: Lanczos' coefficients for g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def gamma(x: Column) -> Column:
    """The gamma function of x >= 1/2, as plain arithmetic."""
    z = x - 1
    a = sum((F.lit(c) / (z + i) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return math.sqrt(2 * math.pi) * F.pow(t, z + 0.5) * F.exp(-t) * a


def series_files(names: DataFrame, name: str, pattern: str, derived: str) -> DataFrame:
    """The names of a series in order: those that fit a pattern and are not derived files."""
    return names.filter(F.col(name).rlike(pattern) & ~F.col(name).rlike(derived)).orderBy(name)


def metadata_log(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line of text a row: ``name: value`` pairs."""
    return df.select(F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in columns]).alias("line"))


def leading_component(df: DataFrame, bands: list[str], k: int, eps: float = 1e-12, rounds: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """The k leading components by fixed-point rounds on the covariance, each orthogonal to the
    ones before; their variances."""
    _, cov = matrices(moments(df, bands).first(), bands)
    out: list[np.ndarray] = []
    for j in range(min(k, len(bands))):
        v = np.eye(len(bands))[j] + 1e-3
        for _ in range(rounds):
            w = cov @ v
            for u in out:
                w = w - u * (u @ w)
            n = np.linalg.norm(w)
            if n == 0:
                break
            w /= n
            near = abs(w @ v)
            v = w
            if 1 - near < eps:
                break
        out.append(v * np.sign(v[np.abs(v).argmax()]))
    vectors = np.array(out).T
    return vectors, np.diag(vectors.T @ cov @ vectors)


def spectral_regression(df: DataFrame, bands: list[str], by: str, alpha: float = 1e-3) -> np.ndarray:
    """Discriminant axes by ridge regression on orthogonal class responses: from class sums and
    the matrix of sums alone."""
    classes, means, _, total = scatters(df, bands, by)
    n = np.array([r["n"] for r in sorted(moments(df, bands, [by]).collect(), key=lambda r: str(r[by]))], float)
    # Responses are constant within a class: orthogonalized against the constant, weighted.
    w = np.sqrt(n)[:, None]
    y = gram_schmidt(np.column_stack([w, np.eye(len(classes)) * w]))[:, 1 : len(classes)]
    y = y / np.maximum(np.linalg.norm(y, axis=0), 1e-300) / w
    mid = (n[:, None] * means).sum(0) / n.sum()
    return np.linalg.solve(total + alpha * np.eye(len(bands)), ((means - mid).T * n) @ y)


def kernel_ridge(df: DataFrame, train: DataFrame, bands: list[str], y: str, ridge: float, sigma: float) -> DataFrame:
    """``fit``: Gaussian kernel regression with an offset, from a bounded training table."""
    rows = np.array([list(r) for r in train.select(*bands, y).collect()], float)
    x, t = rows[:, :-1], rows[:, -1]
    n = len(x)
    system = np.zeros((n + 1, n + 1))
    system[0, 1:], system[1:, 0], system[1:, 1:] = 1, 1, kernel(x, x, sigma=sigma) + ridge * np.eye(n)
    solved = np.linalg.solve(system, np.append(0.0, t))
    return _scored(df, bands, ["fit"], lambda v: (kernel(v, x, sigma=sigma) @ solved[1:] + solved[0])[:, None])


def kernel_fisher(df: DataFrame, train: DataFrame, bands: list[str], positive: str, ridge: float, sigma: float) -> DataFrame:
    """``score`` and ``pred`` of the kernel Fisher discriminant of two classes, from a bounded
    training table."""
    rows = np.array([list(r) for r in train.select(*bands, F.col(positive).cast("int")).collect()], float)
    x, t = rows[:, :-1], rows[:, -1] == 1
    g = kernel(x, x, sigma=sigma)
    means = [g[:, c].mean(1) for c in (t, ~t)]
    within = sum(g[:, c] @ (np.eye(c.sum()) - 1 / c.sum()) @ g[:, c].T for c in (t, ~t))
    a = np.linalg.solve(within + ridge * np.eye(len(x)), means[0] - means[1])
    bias = a @ (means[0] + means[1]) / 2
    return _scored(df, bands, ["score"], lambda v: (kernel(v, x, sigma=sigma) @ a - bias)[:, None]).withColumn("pred", F.col("score") > 0)


def relief_weights(train: DataFrame, bands: list[str], by: str, sigma: float = 1.0, rounds: int = 200, theta: float = 1e-3) -> dict[str, float]:
    """Iterated relief: band weights by expected margins to near misses and hits on a bounded
    table."""
    rows = train.select(*bands, by).collect()
    x, y = np.array([list(r)[:-1] for r in rows], float), np.array([str(r[by]) for r in rows])
    x = (x - x.min(0)) / np.where(np.ptp(x, axis=0) > 0, np.ptp(x, axis=0), 1)
    d = np.abs(x[:, None] - x[None])
    same = y[:, None] == y[None]
    np.fill_diagonal(same, False)
    other = y[:, None] != y[None]
    w = np.ones(len(bands)) / len(bands)
    for _ in range(rounds):
        f = np.exp(-(d @ w) / sigma)
        miss, hit = f * other, f * same
        miss, hit = (m / np.maximum(m.sum(1, keepdims=True), 1e-300) for m in (miss, hit))
        gain = (np.einsum("ij,ijk->ik", miss, d) - np.einsum("ij,ijk->ik", hit, d)).mean(0)
        after = np.maximum(gain, 0)
        after = after / np.linalg.norm(after) if after.any() else w
        moved = np.linalg.norm(after - w)
        w = after
        if moved < theta:
            break
    return dict(zip(bands, w.tolist()))


def eliminate_bands(df: DataFrame, bands: list[str], by: str) -> list[str]:
    """Bands from the least to the most useful: again and again the one with the least squared
    weight of the first discriminant axis goes.  The class moments are read once."""
    _, means, within, total = scatters(df, bands, by)
    left, out = list(range(len(bands))), []
    between = total - within
    while len(left) > 1:
        a = np.linalg.pinv(within[np.ix_(left, left)], hermitian=True) @ between[np.ix_(left, left)]
        values, vectors = np.linalg.eig(a)
        w = vectors[:, values.real.argmax()].real * np.sqrt(np.diag(within)[left])
        out.append(bands[left.pop(int((w * w).argmin()))])
    return [*out, bands[left[0]]]


def organizing_map(df: DataFrame, sample: DataFrame, bands: list[str], side: int = 4, rounds: int = 2000) -> DataFrame:
    """``cell`` (0..side^3 - 1) of a cube of neurons trained on a bounded table, whose rows come
    in turn; rates and reach fall over the rounds."""
    x = np.array([list(r) for r in sample.select(*bands).collect()], float)
    lo, hi = x.min(0), x.max(0)
    at = np.array([(i, j, k) for i in range(side) for j in range(side) for k in range(side)], float)
    w = lo + (hi - lo) * np.random.default_rng(1).random((len(at), len(bands)))
    for t in range(rounds):
        g = x[t % len(x)]
        best = ((w - g) ** 2).sum(1).argmin()
        share = t / rounds
        reach = (side / 2) * (0.25 / (side / 2)) ** share
        near = np.exp(-((at - at[best]) ** 2).sum(1) / (2 * reach**2))
        w += (0.5 * 0.02**share) * near[:, None] * (g - w)
    out = _scored(df, bands, ["cell"], lambda v: ((v[:, None] - w) ** 2).sum(2).argmin(1)[:, None].astype(float))
    return out.withColumn("cell", F.col("cell").cast("int"))


def iterated_pca(df: DataFrame, first: str, second: str, rounds: int = 5) -> tuple[DataFrame, float]:
    """Change between two dates of a band: ``pc2`` of principal components whose covariance is
    weighted, round by round, by the probability that a pixel belongs to the narrower of two
    zero-mean normal parts of pc2.  Gives the rows and the angle of the first axis."""
    from .moments import weighted_moments

    weight = F.lit(1.0)
    angle = 0.0
    for _ in range(rounds):
        mean, cov = matrices(weighted_moments(df.select(first, second), [first, second], weight).first(), [first, second])
        values, vectors = np.linalg.eigh(cov)
        v = vectors[:, 0] * np.sign(vectors[1, 0] or 1)
        angle = float(np.degrees(np.arctan2(abs(vectors[1, 1]), abs(vectors[0, 1]))))
        pc2 = (F.col(first) - float(mean[0])) * float(v[0]) + (F.col(second) - float(mean[1])) * float(v[1])
        narrow, wide = max(values[0], 1e-300), 9 * max(values[0], 1e-300)
        a, b = (F.exp(-pc2 * pc2 / (2 * float(s))) / float(np.sqrt(s)) for s in (narrow, wide))
        weight = F.coalesce(F.try_divide(a, a + b), F.lit(0.0))
    return df.withColumn("pc2", pc2), angle
